"""Table-view operators: optional equality filters, any-column search,
display formatting, user sort and the first-N page (P3, P5, P8, S2, S3).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.dates import year_month

PAGE_ROWS = 500
#: The selections that mean "no filter".
ALL_VALUES = ("All", "All Products", "All Stores", "All Categories")


def filter_equals(df: DataFrame, selections: dict) -> DataFrame:
    """AND of ``col == value`` for each selection that is not one of
    ALL_VALUES (or None); other values that start like them are values.  Plain predicates, so they push into parquet scans
    and through joins/windows on the same keys."""
    conds = [F.col(c) == v for c, v in selections.items()
             if v is not None and v not in ALL_VALUES]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def drop_incomplete(df: DataFrame, columns=None) -> DataFrame:
    """P5: drop rows with a NULL in any of ``columns`` (default: all)."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def sales_display(monthly: DataFrame) -> DataFrame:
    """Month as yyyy-MM, quantity with thousands separators, promotion
    as a check mark or a dash."""
    return monthly.select(
        year_month("date").alias("month"), "store", "product",
        F.format_number(F.col("sales_qty").cast("long"), 0).alias("units"),
        F.when(F.col("promotion") == 1, "✓").otherwise("—").alias("promo"),
        F.col("sales_qty"), F.col("date"))


def sort_by(df: DataFrame, column: str | None, mapping: dict[str, str], tie_keys,
            default: str = "date", ascending: bool = True) -> DataFrame:
    """Sort by the data column behind a display column (unknown -> the
    default), then by tie keys for a deterministic order."""
    target = mapping.get(column or "", default)
    key = F.col(target).asc() if ascending else F.col(target).desc()
    return df.orderBy(key, *[F.col(k).asc() for k in tie_keys])


def first_page(df: DataFrame, n: int = PAGE_ROWS) -> DataFrame:
    """S3: the first n rows of an ordered frame (TakeOrderedAndProject)."""
    return df.limit(n)
