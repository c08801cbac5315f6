"""Calendar functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c, fmt: str | None = None) -> Column:
    """string/timestamp -> DATE; unparsable strings become NULL."""
    c = _c(c)
    if fmt is None:
        return F.coalesce(F.try_to_timestamp(c.cast("string")).cast("date"),
                          c.cast("string").try_cast("date"))
    return F.try_to_timestamp(c.cast("string"), F.lit(fmt)).cast("date")


def month_start(c) -> Column:
    """first day of the month, as DATE (works for DATE and TIMESTAMP_NTZ)."""
    return F.trunc(_c(c).cast("date"), "MM")


def calendar_parts(c) -> dict[str, Column]:
    """month, quarter, year."""
    c = _c(c)
    return {"month": F.month(c), "quarter": F.quarter(c), "year": F.year(c)}


def cyclic_month(month) -> dict[str, Column]:
    """sin/cos encoding of a 1..12 month number."""
    angle = F.lit(2.0 * math.pi) * _c(month) / F.lit(12.0)
    return {"month_sin": F.sin(angle), "month_cos": F.cos(angle)}


def year_month(c) -> Column:
    """``yyyy-MM`` text."""
    return F.date_format(_c(c), "yyyy-MM")


def shift_months(c, n: int) -> Column:
    """calendar month offset; clamps to month end like a DateOffset."""
    return F.add_months(_c(c), n)
