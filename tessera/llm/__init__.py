"""Operators of a training-data pipeline, each a set of Spark jobs.

Nothing outside this folder imports it.  ``queries`` lists the registered
``opN_<name>`` queries.
"""
