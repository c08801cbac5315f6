"""Registered vector queries on the embeddings table (grouped by label)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import vectors as VO
from tessera.session import materialize
from tessera.sources import views
from tessera.sources.views_sql import SHORT_VECTOR_SETS, VECTOR_SETS

R = 6
SENT_GROUPS = 10_000  # one vector each


def _round_arr(c):
    return F.transform(c, lambda x: F.round(x, R) + F.lit(0.0))


def q_first_vector_projection(spark, sf_dir) -> DataFrame:
    """V1-V4, V7 row-wise: every vector against its group's first vector
    (the first Gram-Schmidt step applied to all rows).  The first vector per
    group is an aggregate (``min_by``), one vector per group; it is stored and
    sent to every task if there are few groups, so that no vector is shuffled
    by its group (a handful of keys), and joined otherwise."""
    vs = views.vector_sets(spark, sf_dir)
    first = materialize(vs.groupBy("grp").agg(F.min_by("vec", "ord").alias("first")))
    j = vs.join(F.broadcast(first) if first.count() <= SENT_GROUPS else first, "grp")
    return j.select(
        "grp", "ord",
        (F.round(V.dot("vec", "first"), R) + F.lit(0.0)).alias("dot_first"),
        _round_arr(V.projection("vec", "first")).alias("proj_first"),
        _round_arr(V.subtract("vec", V.projection("vec", "first"))).alias("resid_first"),
        _round_arr(V.normalize("vec")).alias("unit"))


def q_gram_schmidt(spark, sf_dir) -> DataFrame:
    gs = VO.gram_schmidt(views.vector_sets(spark, sf_dir))
    return gs.select("grp", "ord", _round_arr(F.col("u")).alias("u"))


def q_gram_schmidt_short(spark, sf_dir) -> DataFrame:
    """V5 where groups have many more rows than dimensions."""
    gs = VO.gram_schmidt(views.short_vector_sets(spark, sf_dir))
    return gs.select("grp", "ord", _round_arr(F.col("u")).alias("u"))


def q_basis_orthogonality(spark, sf_dir) -> DataFrame:
    o = VO.basis_orthogonality(VO.gram_schmidt(views.vector_sets(spark, sf_dir)))
    return o.select("grp", "n_basis", "orthogonal")


QUERIES = {
    "first_vector_projection": q_first_vector_projection,
    "gram_schmidt": q_gram_schmidt,
    "gram_schmidt_short": q_gram_schmidt_short,
    "basis_orthogonality": q_basis_orthogonality,
}


# ------------------------------------------------------------------ oracles
def _dot(a: str, b: str) -> str:
    return f"list_reduce(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]), lambda x, y: x + y, 0.0E0)"


def _rarr(e: str) -> str:
    return f"list_transform({e}, lambda x: round(x, {R}) + 0.0E0)"


_COEF = f"({_dot('vec', 'first')}) / ({_dot('first', 'first')})"
_PROJ = f"list_transform(first, lambda y: y * ({_COEF}))"
_RESID = (f"list_reduce(list_transform(basis, lambda u: {{'u': u, 'c': ({_dot('vec', 'u')}) / ({_dot('u', 'u')})}}), "
          "lambda r, s: list_transform(list_zip(r, s.u), lambda p: p[1] - p[2] * s.c), vec)")

ZERO_SHARE = "1e-20"  # a residual of at most 1e-10 times the vector's length is zero


def _gs_sql(sets: str) -> str:
    return f"""
WITH RECURSIVE vs AS ({sets.strip()}),
v AS (SELECT grp, ord, vec, row_number() OVER (PARTITION BY grp ORDER BY ord) AS pos,
             max(len(vec)) OVER () AS dim FROM vs),
gs AS (
  SELECT grp, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS ord, []::DOUBLE[][] AS basis,
         CAST(NULL AS DOUBLE[]) AS u FROM (SELECT DISTINCT grp FROM v)
  UNION ALL
  SELECT grp, pos, ord, CASE WHEN z THEN basis ELSE list_append(basis, r) END,
         CASE WHEN z THEN NULL ELSE r END FROM (
    SELECT grp, pos, ord, basis, r,
           (len(basis) >= dim OR vv <= 0 OR ({_dot('r', 'r')}) <= {ZERO_SHARE} * vv) AS z FROM (
      SELECT g.grp, v.pos, v.ord, g.basis, v.dim, {_dot('v.vec', 'v.vec')} AS vv,
             {_RESID.replace('vec', 'v.vec').replace('basis', 'g.basis')} AS r
      FROM gs g JOIN v ON v.grp IS NOT DISTINCT FROM g.grp AND v.pos = g.pos + 1)))
"""

ORACLES = {
    "first_vector_projection": f"""
WITH vs AS ({VECTOR_SETS.strip()}),
f AS (SELECT grp, arg_min(vec, ord) AS first FROM vs GROUP BY grp),
j AS (SELECT vs.grp, vs.ord, vs.vec, f.first FROM vs JOIN f USING (grp))
SELECT grp, ord, round({_dot('vec', 'first')}, {R}) + 0.0E0 AS dot_first,
       CASE WHEN ({_dot('first', 'first')}) = 0 THEN NULL ELSE {_rarr(_PROJ)} END AS proj_first,
       CASE WHEN ({_dot('first', 'first')}) = 0 THEN NULL
            ELSE {_rarr(f"list_transform(list_zip(vec, {_PROJ}), lambda p: p[1] - p[2])")} END AS resid_first,
       CASE WHEN sqrt({_dot('vec', 'vec')}) > 0
            THEN {_rarr(f"list_transform(vec, lambda x: x / sqrt({_dot('vec', 'vec')}))")} END AS unit
FROM j""",
    "gram_schmidt": _gs_sql(VECTOR_SETS) + f"SELECT grp, ord, {_rarr('u')} AS u FROM gs WHERE pos > 0",
    "gram_schmidt_short": _gs_sql(SHORT_VECTOR_SETS) + f"SELECT grp, ord, {_rarr('u')} AS u FROM gs WHERE pos > 0",
    "basis_orthogonality": _gs_sql(VECTOR_SETS) + f"""
, b AS (SELECT grp, ord, u FROM gs WHERE pos > 0 AND u IS NOT NULL)
SELECT grp, n_basis, coalesce(max_abs_dot, 0.0E0) < 1e-4 AS orthogonal FROM (
  SELECT grp, count(*) AS n_basis FROM b GROUP BY grp) n
LEFT JOIN (SELECT a.grp, max(abs({_dot('a.u', 'c.u')})) AS max_abs_dot
           FROM b a JOIN b c ON a.grp = c.grp AND a.ord < c.ord GROUP BY a.grp) m USING (grp)""",
}
