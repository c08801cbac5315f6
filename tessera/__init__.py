"""tessera: Spark-native panel, review-text, entity and vector analytics.

Every public operator is DataFrame -> DataFrame (or Column -> Column) and
composes with ``df.transform``.  Heavy work stays in Spark SQL expressions,
window functions, joins and Spark ML; Python only configures plans.
"""

__version__ = "0.1.0"
