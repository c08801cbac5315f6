"""Entity operators: profiles, department lookups, recommendation, rank and
feature-space matching, top lists (A15-A17, A21, J1, R1-R6, S4, P10, M4).

Scale notes
-----------
* The profile is one grouped aggregate (mean / smallest mode), partial per
  partition; ``mode`` keeps a value->count map per group, bounded by the
  number of distinct values, not rows.
* Batch recommendation never pairs every request with every entity.  The
  top-k of ``base + 10*match`` for a request is contained in
  (top-k by base over all entities) U (top-k by base + 10 over the entities
  offering the requested department).  Both scores are linear in the GPA with
  the overall score as the slope, so an entity that k others beat in overall
  and in preference score is out for every GPA; only the others are scored,
  per *distinct* (gpa, preference[, department]), and requests join that
  result with an equi-join.
* Single-request matching (closest rank, nearest neighbour, top lists) is a
  distributed top-k (TakeOrderedAndProject) over the profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import keyword_class
from tessera.session import materialize

NUMERIC = ("overall_score", "research_score", "teaching_score", "hec_score", "hec_rank", "year_founded")
FEATURES = ("overall_score", "research_score", "teaching_score", "hec_score")
PREFERENCES = ("Public", "Private", "Balanced")
# Keyword list of the public/private rule and the score
# constants of the advisor (bonus for the preferred type, department match).
PUBLIC_KEYWORDS = ("university of", "government", "national", "public")
TYPE_BONUS, DEPT_BONUS = 15.0, 10.0
# Ranges of the overall score that the recommendation compares candidates by.
SCORE_CELLS = 256
# Rank-difference verdict ladder (P10).
VERDICTS = ((0, "perfect"), (3, "excellent"), (5, "good"))


# ------------------------------------------------------------- A15 / F14
def entity_profile(raw: DataFrame, key: str = "entity", keywords=PUBLIC_KEYWORDS) -> DataFrame:
    """A15 + F14: mean of numeric columns, smallest mode of the others, and
    the keyword-based type."""
    numeric = {f.name for f in raw.schema.fields
               if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "decimal")}
    aggs = []
    for c in raw.columns:
        if c == key:
            continue
        aggs.append(F.avg(c).alias(c) if c in numeric else F.mode(c, True).alias(c))
    prof = raw.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)
    return prof.withColumn("type", keyword_class(F.col(key), keywords))


# ------------------------------------------------------------- A16 / A17 / J1
def departments_text(raw: DataFrame, key: str = "entity", col: str = "department") -> DataFrame:
    """Each entity's distinct departments, sorted, comma-joined."""
    return raw.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_set(col)), ", ").alias("departments"))


def department_domain(raw: DataFrame, col: str = "department") -> DataFrame:
    """Sorted distinct departments."""
    return raw.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def offers_flags(raw: DataFrame, department, key: str = "entity") -> DataFrame:
    """(entity, offers) with offers = entity has a record in ``department``."""
    dep = department if isinstance(department, Column) else F.lit(department)
    return raw.groupBy(key).agg(F.bool_or(F.col("department") == dep).alias("offers"))


def with_department_flag(profile: DataFrame, raw: DataFrame, department, key: str = "entity") -> DataFrame:
    """Left lookup join of the per-entity flag onto the profile.

    Both sides have one row per entity (same key cardinality), so this is a
    plain equi-join; the planner broadcasts whichever side is small.
    """
    flags = offers_flags(raw, department, key)
    return (profile.join(flags, key, "left")
                   .withColumn("offers", F.coalesce("offers", F.lit(False))))


# ------------------------------------------------------------- R1-R3
def preference_score(pref: str) -> Column:
    """R2: preference part of the advisor score for one preference mode."""
    if pref == "Public":
        return F.col("research_score") + F.when(F.col("type") == "Public", TYPE_BONUS).otherwise(0.0)
    if pref == "Private":
        return F.col("teaching_score") + F.when(F.col("type") == "Private", TYPE_BONUS).otherwise(0.0)
    return (F.col("research_score") + F.col("teaching_score")) / 2.0


def advisor_scores(profile: DataFrame, gpa: float, preference: str, match: DataFrame | None = None,
                   key: str = "entity") -> DataFrame:
    """R1-R3 for one request: base + preference + 10 * department match."""
    p = profile
    if match is not None:
        p = p.join(match, key, "left").withColumn("offers", F.coalesce("offers", F.lit(False)))
    else:
        p = p.withColumn("offers", F.lit(False))
    base = F.col("overall_score") * (F.lit(float(gpa)) / 4.0)
    score = base + preference_score(preference) + F.col("offers").cast("double") * DEPT_BONUS
    return p.withColumn("final_score", score)


def recommend(profile: DataFrame, raw: DataFrame, gpa: float, preference: str, department: str,
              k: int = 5, key: str = "entity") -> DataFrame:
    """R3 single request: top-k by final score (ties by entity)."""
    s = advisor_scores(profile, gpa, preference, offers_flags(raw, department, key), key)
    return s.orderBy(F.desc("final_score"), F.asc(key)).limit(k)


def _pref_rows(profile: DataFrame, key: str) -> DataFrame:
    """(entity, overall_score, preference, pref_score): 3 rows per entity."""
    arr = F.array(*[F.struct(F.lit(p).alias("preference"), preference_score(p).alias("pref_score"))
                    for p in PREFERENCES])
    return profile.select(key, "overall_score", F.explode(arr).alias("p")).select(
        key, "overall_score", "p.preference", "p.pref_score")


def _undominated(rows: DataFrame, groups: list[str], k: int) -> DataFrame:
    """Rows (overall_score, pref_score, *groups) that may be among the best k
    of their group for some GPA >= 0.

    The overall score is cut into SCORE_CELLS ranges; a row is out if k rows of
    higher ranges have a larger preference score.  The k-th such score per range
    follows from each range's k best.
    """
    bounds = rows.select(F.struct(F.min("overall_score").alias("lo"), F.max("overall_score").alias("hi"))).scalar()
    width = (bounds["hi"] - bounds["lo"]) / SCORE_CELLS
    cell = F.when(width > 0, F.floor((F.col("overall_score") - bounds["lo"]) / width)).otherwise(0)
    celled = rows.withColumn("_cell", F.coalesce(cell, F.lit(-1)).cast("int"))
    best = Window.partitionBy(*groups, "_cell").orderBy(F.desc("pref_score"))
    tops = (celled.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
                  .groupBy(*groups, "_cell").agg(F.collect_list("pref_score").alias("_tops")))
    above = Window.partitionBy(*groups).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    over = F.get(F.sort_array(F.flatten(F.collect_list("_tops").over(above)), asc=False), F.lit(k - 1))
    limits = tops.select(*groups, "_cell", over.alias("_limit"))
    kept = celled.join(limits, [*groups, "_cell"]).where(F.col("_limit").isNull() | F.col("pref_score").isNull() | (F.col("pref_score") >= F.col("_limit")))
    return kept.drop("_cell", "_limit")


def recommend_batch(profile: DataFrame, raw: DataFrame, requests: DataFrame, k: int = 5,
                    key: str = "entity") -> DataFrame:
    """R3 + W8 for a table of requests: (request_id, rank, entity, final_score).

    Exact (see the module notes), for any GPAs: a NULL or negative one counts
    as 0.  Every request is answered: a preference other than Public or Private
    (NULL too) is Balanced, and a NULL or unknown department earns no bonus.
    """
    pref = F.when(F.col("preference").isin("Public", "Private"), F.col("preference")).otherwise("Balanced")
    asked = requests.select("request_id", F.greatest(F.coalesce("gpa", F.lit(0.0)), F.lit(0.0)).alias("gpa"), pref.alias("preference"),
                            F.col("department").alias("wanted"))
    prefs = materialize(_pref_rows(profile, key))
    base = F.col("overall_score") * (F.col("gpa") / 4.0) + F.col("pref_score")
    order = [F.desc("base"), F.asc(key)]

    keys = asked.select("gpa", "preference").distinct()
    w_a = Window.partitionBy("gpa", "preference").orderBy(*order)
    cand_all = (_undominated(prefs, ["preference"], k).join(keys, "preference").withColumn("base", base)
                .withColumn("_r", F.row_number().over(w_a)).where(F.col("_r") <= k).select("gpa", "preference", key, "base"))

    offered = materialize(raw.select(key, F.col("department").alias("wanted")).where(F.col("wanted").isNotNull()).distinct())
    profiles = materialize(asked.select("gpa", "preference", "wanted").distinct())
    w_b = Window.partitionBy("gpa", "preference", "wanted").orderBy(*order)
    cand_dept = (_undominated(prefs.join(offered, key), ["preference", "wanted"], k)
                 .join(profiles, ["preference", "wanted"]).withColumn("base", base)
                 .withColumn("_r", F.row_number().over(w_b)).where(F.col("_r") <= k))

    cols = ["gpa", "preference", "wanted", key]
    a = (profiles.join(cand_all, ["gpa", "preference"])
                 .join(offered.withColumn("offers", F.lit(True)), [key, "wanted"], "left")
                 .select(*cols, (F.col("base") + F.coalesce("offers", F.lit(False)).cast("double") * DEPT_BONUS).alias("final_score")))
    b = cand_dept.select(*cols, (F.col("base") + F.lit(1.0) * DEPT_BONUS).alias("final_score"))
    cands = a.unionByName(b).dropDuplicates(cols)
    w_c = Window.partitionBy("gpa", "preference", "wanted").orderBy(F.desc("final_score"), F.asc(key))
    top = (cands.withColumn("rank", F.row_number().over(w_c)).where(F.col("rank") <= k)
                .select(*[F.col(c).alias("_" + c) for c in ("gpa", "preference", "wanted")], "rank", key, "final_score"))
    same = (F.col("gpa") == F.col("_gpa")) & (F.col("preference") == F.col("_preference")) & F.col("wanted").eqNullSafe(F.col("_wanted"))
    return asked.join(top, same).select("request_id", "rank", key, "final_score")


# ------------------------------------------------------------- R5 / P10
def rank_verdict(diff) -> Column:
    """P10: verdict label for an absolute rank difference."""
    d = diff if isinstance(diff, Column) else F.col(diff)
    expr = None
    for limit, label in VERDICTS:
        cond = (d == 0) if limit == 0 else (d <= limit)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise("error")


def closest_by_rank(profile: DataFrame, predicted_rank, k: int = 5, key: str = "entity") -> DataFrame:
    """K entities with the smallest |hec_rank - predicted| (ties by name)."""
    pred = predicted_rank if isinstance(predicted_rank, Column) else F.lit(int(predicted_rank))
    return (profile.withColumn("rank_diff", F.abs(F.col("hec_rank") - pred))
                   .orderBy("rank_diff", key).limit(k)
                   .withColumn("verdict", rank_verdict(F.col("rank_diff"))))


# ------------------------------------------------------------- A21 / M4 / R6
def scaling_stats(df: DataFrame, features=FEATURES) -> DataFrame:
    """Mean and population std per feature (one row, 2 columns each)."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_std")]
    return df.agg(*aggs)


def standard_scale(df: DataFrame, features=FEATURES, stats: DataFrame | None = None) -> DataFrame:
    """M4: (x - mean) / population std, with statistics as scalar subqueries.

    A zero std leaves the centred value unscaled (sklearn's convention).
    """
    st = _stats_scalar(stats if stats is not None else scaling_stats(df, features))
    cols = {f"{f}_z": _z(F.col(f), st, f) for f in features}
    return df.withColumns(cols)


def _stats_scalar(stats: DataFrame) -> Column:
    """The one-row statistics frame as ONE scalar subquery (a struct), so
    Spark evaluates it once and reuses it for every feature."""
    return stats.select(F.struct(*stats.columns)).scalar()


def _z(value: Column, st: Column, f: str) -> Column:
    std = st[f"{f}_std"]
    safe = F.when(std == 0, F.lit(1.0)).otherwise(std)
    return (value - st[f"{f}_mean"]) / safe


def nearest_entity(profile: DataFrame, point: dict[str, float], k: int = 1,
                   features=FEATURES, key: str = "entity") -> DataFrame:
    """Entity nearest to a query point in standard-scaled feature space."""
    stats = scaling_stats(profile, features)
    scaled = standard_scale(profile, features, stats)
    st = _stats_scalar(stats)
    sq = None
    for f in features:
        d = F.col(f"{f}_z") - _z(F.lit(float(point[f])), st, f)
        sq = d * d if sq is None else sq + d * d
    return (scaled.withColumn("distance", F.sqrt(sq))
                  .orderBy("distance", key).limit(k)
                  .select(key, "hec_rank", "distance"))


# ------------------------------------------------------------- S4
def top_lists(profile: DataFrame, k: int = 10, key: str = "entity") -> DataFrame:
    """The four insight lists (overall, public, private, research), tagged
    with ``view`` and 1-based ``rank``: one pass over the profile, a partial
    top-k per view and task (WindowGroupLimit)."""
    def view(name, score, member=None):
        row = F.struct(F.lit(name).alias("view"), F.col(score).cast("double").alias("score"))
        return row if member is None else F.when(F.col("type") == member, row)

    views = F.array(view("overall", "overall_score"), view("public", "overall_score", "Public"),
                    view("private", "overall_score", "Private"), view("research", "research_score"))
    rows = profile.select(key, "type", "hec_rank", F.explode(views).alias("v")).where("v is not null")
    w = Window.partitionBy("v.view").orderBy(F.desc("v.score"), F.asc(key))
    return (rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                .select("v.view", key, "type", "v.score", "hec_rank", "rank"))
