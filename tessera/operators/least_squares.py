"""Least squares in one aggregate pass (M6).

Covariances of all features with one another and with the label are one row of
aggregates (merged from partial moments, so large means cost no digits).  The
correlations are solved by elimination inside that row; a feature whose rest,
after those before it, is below a tolerance depends on them and gets no weight,
as the reference's rolling means of its own lags do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import let

#: Share of a feature's variance that the features before it must leave.
LEAST_REST = 1e-8
#: Spread of a feature that is not constant, relative to its mean.
LEAST_SPREAD = 1e-9


def moments(data: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row: means (features, then the label), spreads, and the upper half of the covariances."""
    names = [*features, label]
    aggs = [F.avg(c).alias(f"m{i}") for i, c in enumerate(names)]
    aggs += [F.covar_pop(a, names[j]).alias(f"c{i}_{j}") for i, a in enumerate(names) for j in range(i, len(names))]
    return data.agg(*aggs)


def coefficients(data: DataFrame, features: list[str], label: str) -> DataFrame:
    """One row: ``weights`` (one a feature, 0 for a dependent or constant one) and ``intercept``.

    Rows with a null in any column take no part; without rows both are null.
    """
    data = data.select(*[F.col(c).cast("double").alias(c) for c in [*features, label]]).na.drop()
    p = len(features)
    row = moments(data, features, label)
    spread = [F.sqrt(F.col(f"c{i}_{i}")) for i in range(p + 1)]
    # a spread of nothing but rounding errors is a constant's
    scale = [F.when(s > LEAST_SPREAD * F.abs(F.col(f"m{i}")), s).otherwise(1.0) for i, s in enumerate(spread)]
    cell = lambda i, j: F.col(f"c{min(i, j)}_{max(i, j)}") / (scale[i] * scale[j])
    row = row.select(F.array(*[f"m{i}" for i in range(p + 1)]).alias("means"), F.array(*scale).alias("scale"),
                     F.array(*[F.array(*[cell(i, j) for j in range(p + 1)]) for i in range(p)]).alias("rows"))

    def step(rows: Column, k: Column) -> Column:
        """Clear feature k out of all other rows, or its own row if it depends on those before."""
        def cleared(own: Column) -> Column:
            return let(F.get(own, k), lambda pivot: F.when(pivot > LEAST_REST, let(
                F.transform(own, lambda x: x / pivot), lambda unit: F.transform(rows, lambda r, i: F.when(i == k, unit).otherwise(
                    let(F.get(r, k), lambda by: F.zip_with(r, unit, lambda x, u: x - by * u)))))).otherwise(
                F.transform(rows, lambda r, i: F.when(i == k, F.transform(r, lambda x: F.lit(0.0))).otherwise(r))))

        return let(F.get(rows, k), cleared)

    solved = F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), F.col("rows"), step)
    row = row.withColumn("solved", solved).withColumn("weights", F.transform("solved", lambda r, i: F.get(r, F.lit(p)) * F.get("scale", F.lit(p)) / F.get("scale", i)))
    lean = F.aggregate(F.zip_with("weights", F.slice("means", 1, p), lambda w, m: w * m), F.lit(0.0), lambda s, x: s + x)
    return row.select("weights", (F.get("means", F.lit(p)) - lean).alias("intercept"))


def predicted(data: DataFrame, fitted: DataFrame, features: list[str]) -> Column:
    """Prediction for rows of ``data`` by a row of ``coefficients``; null with a null feature."""
    one = fitted.select(F.struct("weights", "intercept")).scalar()
    out = one["intercept"]
    for i, c in enumerate(features):
        out = out + F.get(one["weights"], F.lit(i)) * F.col(c).cast("double")
    return out
