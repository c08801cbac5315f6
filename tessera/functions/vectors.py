"""Vector algebra on ``array<double>`` columns (V1-V4, V7).

Higher-order array functions (``zip_with``, ``transform``, ``aggregate``)
are JVM expressions (interpreted per element, outside whole-stage code
generation); sums run left to right.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import let


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a, b) -> Column:
    """V1: sum_k a_k * b_k (left-to-right)."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def scale(v, s) -> Column:
    """V2: v * s (s evaluated once per row)."""
    s = s if isinstance(s, Column) else F.lit(float(s))
    return let(s, lambda c: F.transform(_c(v), lambda x: x * c))


def subtract(a, b) -> Column:
    """V3: a - b."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def projection(v, u) -> Column:
    """V4: projection of v on u = (v.u / u.u) * u; NULL when u is zero."""
    coef = F.try_divide(dot(v, u), dot(u, u))
    return let(coef, lambda c: F.when(c.isNotNull(), F.transform(_c(u), lambda x: x * c)))


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v) -> Column:
    """V7: unit vector; NULL for a zero vector."""
    return let(norm(v), lambda n: F.when(n > 0, F.transform(_c(v), lambda x: x / n)))


def residual(v, basis) -> Column:
    """Classical Gram-Schmidt step: v minus its projections on each vector of
    ``basis`` (array<array<double>>), each coefficient taken from the
    original v:  r <- r - u_j * ((v.u_j) / (u_j.u_j))."""
    v = _c(v)
    # coefficients first (one dot pair per basis vector), then the
    # subtractions in basis order
    coefs = F.transform(_c(basis), lambda u: F.struct(u.alias("u"), (dot(v, u) / dot(u, u)).alias("c")))
    return F.aggregate(coefs, v, lambda r, s: F.zip_with(r, s["u"], lambda x, y: x - y * s["c"]))
