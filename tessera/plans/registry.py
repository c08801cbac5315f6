"""Merged registry of queries (name -> callable(spark, sf_dir)) and oracles."""

from __future__ import annotations

import importlib

_MODULES = ("tessera.plans.panel_queries", "tessera.plans.text_queries",
            "tessera.plans.entity_queries", "tessera.plans.matching_queries", "tessera.plans.vector_queries",
            "tessera.plans.contract_queries", "tessera.plans.rule_queries",
            "tessera.plans.ml_queries")


def _load():
    queries, oracles = {}, {}
    for name in _MODULES:
        mod = importlib.import_module(name)
        for k, v in mod.QUERIES.items():
            if k in queries:
                raise ValueError(f"duplicate query name {k}")
            queries[k] = v
        oracles.update(getattr(mod, "ORACLES", {}))
    return queries, oracles


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]
