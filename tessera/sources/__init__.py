"""Sources and sinks: driver tables, derived views, column contracts, writers."""

from tessera.sources.tables import TABLES, read_table, register_tables
from tessera.sources.views import entities_raw, requests, reviews, sales, vector_sets

__all__ = ["TABLES", "read_table", "register_tables", "sales", "reviews",
           "entities_raw", "requests", "vector_sets"]
