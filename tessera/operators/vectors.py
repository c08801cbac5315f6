"""Grouped vector operators: pairwise dot products within a group's basis,
classical Gram-Schmidt per group, orthogonality check (V5-V6).

Gram-Schmidt plan
-----------------
Classical Gram-Schmidt is sequential within a group, but its state is
small: the non-zero vectors produced so far.  In dimension d at most d of
them exist, and a vector that depends on them stays dependent whatever is
added.  So the operator looks only for the rows that enter a basis:

1. every unfinished group takes the next ``d`` rows, by order, that lie after
   its last processed row and do not depend on its basis (``rank() <= d`` ->
   WindowGroupLimit: a partial top-d per map task, never a whole group in one
   task; equal rows count once),
2. these rows are folded, in order, against the group's carried basis with
   nested ``aggregate`` (JVM-side, <= d rows x <= d basis vectors),
3. a group is finished when its basis has d vectors or no such row is left.

The first row of each round always enters the basis, so there are at most d
rounds (one or two unless rows depend on one another).  A round stores at
most d vectors a group.  One join at the end gives every other row NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import let
from tessera.functions.vectors import dot, normalize, residual
from tessera.session import materialize

ZERO_TOL = 1e-10  # |u| <= tol * |v|  ->  v depends on the previous vectors
BASIS_T = "array<array<double>>"


def _depends(v, u, tol: float):
    """The residual u of v is zero, or cannot be told (nulls, other length, not finite)."""
    uu, vv = dot(u, u), dot(v, v)
    return ~F.coalesce((uu > F.lit(tol * tol) * vv) & (vv > 0) & (vv < float("inf")) & ~F.isnan(uu), F.lit(False))


def _fold(chunk_rows, basis, dim: int, tol: float):
    """Fold ordered (ord, vec) structs against a starting basis."""
    out_t = "array<struct<ord:bigint,vec:array<double>,u:array<double>>>"
    init = F.struct(basis.alias("basis"), F.array().cast(out_t).alias("out"))

    def step(acc, r):
        def with_u(u):  # u: the residual, computed once per row via let()
            enters = (F.size(acc["basis"]) < dim) & ~_depends(r["vec"], u, tol)
            return F.struct(
                F.when(enters, F.concat(acc["basis"], F.array(u))).otherwise(acc["basis"]).alias("basis"),
                F.when(enters, F.concat(acc["out"], F.array(F.struct(
                    r["ord"].alias("ord"), r["vec"].alias("vec"), u.alias("u"))))).otherwise(acc["out"]).alias("out"))
        return let(residual(r["vec"], acc["basis"]), with_u)

    return F.aggregate(chunk_rows, init, step)


def gram_schmidt(vs: DataFrame, grp: str = "grp", order: str = "ord", vec: str = "vec",
                 tol: float = ZERO_TOL, orthonormal: bool = False) -> DataFrame:
    """V5: (grp, ord, u) for every input row; u NULL for dependent vectors.

    Rows are processed by order (NULL first), then by vector.  A NULL group is
    a group; of equal rows one counts and the others depend on it; NULL
    vectors, vectors of another length than the basis and vectors with
    non-finite parts depend.  ``orthonormal=True`` (V7) scales each non-NULL u
    to unit length after the classical process, which itself works on the
    unnormalised vectors.
    """
    base = vs.select(F.col(grp).alias("grp"), F.col(order).cast("bigint").alias("ord"),
                     F.col(vec).cast("array<double>").alias("vec"))
    found = _basis_rows(base, tol)
    keys = found.select(*[F.col(c).alias("_" + c) for c in ("grp", "ord", "vec")])
    same = F.col("grp").eqNullSafe(F.col("_grp")) & F.col("ord").eqNullSafe(F.col("_ord")) & (F.col("vec") == F.col("_vec"))
    none = F.lit(None).cast("array<double>")
    rest = base.join(keys, same, "left_anti").select("grp", "ord", none.alias("u"))
    # of the rows equal to one that entered the basis, one keeps u
    entered = base.join(keys, same, "left_semi").groupBy("grp", "ord", "vec").agg(F.count("*").alias("n"))
    copies = entered.where("n > 1").select("grp", "ord", F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("n")))).select("grp", "ord", none.alias("u"))
    out = found.select("grp", "ord", "u").union(copies).union(rest)
    return out.withColumn("u", normalize("u")) if orthonormal else out


def _basis_rows(base: DataFrame, tol: float) -> DataFrame:
    """(grp, ord, vec, u) of the rows that enter their group's basis, stored."""
    dim = max(int(base.select(F.max(F.size("vec"))).first()[0] or 0), 1)
    rows = base.where(F.col("vec").isNotNull())
    state, results = None, []
    while True:
        if state is None:
            left = rows.withColumn("basis", F.array().cast(BASIS_T))
        else:
            known = state.withColumnRenamed("grp", "g")
            left = rows.join(known, F.col("grp").eqNullSafe(F.col("g"))).where(F.struct("ord", "vec") > F.col("last"))
        left = left.where(let(residual("vec", "basis"), lambda u: ~_depends(F.col("vec"), u, tol)))
        order = Window.partitionBy("grp").orderBy("ord", "vec")
        head = left.withColumn("_rank", F.rank().over(order)).where(F.col("_rank") <= dim)
        folded = materialize(
            head.groupBy("grp", "ord", "vec").agg(F.first("basis").alias("basis"))
                .groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("ord", "vec"))).alias("rows"), F.first("basis").alias("basis"))
                .select("grp", _fold(F.col("rows"), F.col("basis"), dim, tol).alias("f"), F.element_at("rows", -1).alias("last")))
        results.append(folded.select("grp", F.explode("f.out").alias("o")).select("grp", "o.ord", "o.vec", "o.u"))
        state = folded.where(F.size("f.basis") < dim).select("grp", F.col("f.basis").alias("basis"), "last")
        if state.isEmpty():
            break
    out = results[0]
    for r in results[1:]:
        out = out.union(r)
    return materialize(out)


def basis_orthogonality(gs: DataFrame, tol: float = 1e-4) -> DataFrame:
    """V6: per group, the largest |u_i . u_j| over pairs of non-NULL results.

    Non-NULL results per group are at most the dimension d (they are
    independent), so the pair computation inside one row is bounded by d^2
    regardless of how many rows the group has.
    """
    basis = (gs.where(F.col("u").isNotNull())
               .groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("ord", "u"))).alias("b")))
    idx = F.sequence(F.lit(1), F.size("b"))

    def row_max(i):
        later = F.slice(F.col("b"), i + 1, F.greatest(F.size("b") - i, F.lit(0)))
        ui = F.element_at(F.col("b"), i)["u"]
        return F.aggregate(later, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(dot(ui, x["u"]))))

    max_dot = F.aggregate(F.transform(idx, row_max), F.lit(0.0), lambda m, x: F.greatest(m, x))
    return basis.select("grp", F.size("b").alias("n_basis"), max_dot.alias("max_abs_dot"),
                        (max_dot < tol).alias("orthogonal"))
