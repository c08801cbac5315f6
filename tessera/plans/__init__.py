"""Registered end-to-end queries (Spark side + DuckDB oracle SQL) and the
Spark ML flows of the three model-fitting applications."""
