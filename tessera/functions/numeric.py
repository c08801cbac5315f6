"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip_at_zero(c) -> Column:
    """F8: max(x, 0)."""
    return F.greatest(_c(c).cast("double"), F.lit(0.0))


def truncate_int(c) -> Column:
    """F16: toward-zero truncation, NULL (not an error) for NaN/overflow."""
    return _c(c).try_cast("int")


def round_half_even(c, digits: int = 2) -> Column:
    """Python ``round`` semantics (banker's rounding)."""
    return F.bround(_c(c), digits)


def abs_diff(a, b) -> Column:
    """F18."""
    return F.abs(_c(a) - _c(b))


def forecast_band(pred, pct: float = 0.08) -> dict[str, Column]:
    """lower/upper band around a prediction."""
    p = _c(pred)
    return {"lower": p * F.lit(1.0 - pct), "upper": p * F.lit(1.0 + pct)}


def residual(actual, pred) -> dict[str, Column]:
    """residual and its sign label."""
    r = _c(actual) - _c(pred)
    return {"residual": r,
            "residual_sign": F.when(r > 0, "under").when(r < 0, "over").otherwise("exact")}


def agreement(*preds) -> dict[str, Column]:
    """do all predictions agree; their min, max and spread."""
    cols = [_c(p) for p in preds]
    lo, hi = F.least(*cols), F.greatest(*cols)
    return {"pred_min": lo, "pred_max": hi, "pred_spread": hi - lo,
            "all_agree": lo == hi}
