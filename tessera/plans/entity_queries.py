"""Registered entity queries (profiles, lookups, recommendation, matching)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import entities as E
from tessera.sources import views
from tessera.sources.views_sql import with_views

R = 6
# The fixture's entity names contain none of the default public keywords;
# these two split them into both classes (FIXTURES.md B).
FIXTURE_KEYWORDS = ("red", "large")
ADVISOR_GPA, ADVISOR_PREFERENCE = 3.0, "Public"
SIMULATED_RANK = 35
# Rank-simulator slider defaults: overall, research, teaching, hec score.
QUERY_POINT = {"overall_score": 75.0, "research_score": 70.0, "teaching_score": 72.0, "hec_score": 80.0}


def _round(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), R) + F.lit(0.0) for c in cols})


def raw(spark, sf_dir) -> DataFrame:
    return views.entities_raw(spark, sf_dir)


def profile(spark, sf_dir) -> DataFrame:
    return E.entity_profile(raw(spark, sf_dir), keywords=FIXTURE_KEYWORDS)


def first_department(r: DataFrame):
    """A department that exists in the data (the smallest), as a scalar."""
    return r.select(F.min("department")).scalar()


# ------------------------------------------------------------------ queries
def q_entity_profile(spark, sf_dir):
    return profile(spark, sf_dir)


def q_entity_departments(spark, sf_dir):
    return E.departments_text(raw(spark, sf_dir))


def q_department_domain(spark, sf_dir):
    return E.department_domain(raw(spark, sf_dir))


def q_department_offer_flags(spark, sf_dir):
    r = raw(spark, sf_dir)
    p = profile(spark, sf_dir)
    return E.with_department_flag(p, r, first_department(r)).select(
        "entity", "type", "overall_score", "offers")


def q_advisor_top5(spark, sf_dir):
    r = raw(spark, sf_dir)
    p = profile(spark, sf_dir)
    s = E.advisor_scores(p, ADVISOR_GPA, ADVISOR_PREFERENCE, E.offers_flags(r, first_department(r)))
    top = s.orderBy(F.desc("final_score"), F.asc("entity")).limit(5)
    return _round(top.select("entity", "type", "offers", "final_score"), ["final_score"])


def q_batch_recommendations(spark, sf_dir):
    out = E.recommend_batch(profile(spark, sf_dir), raw(spark, sf_dir), views.requests(spark, sf_dir))
    return _round(out.withColumn("rank", F.col("rank").cast("int")), ["final_score"])


def q_batch_recommendations_any(spark, sf_dir):
    out = E.recommend_batch(profile(spark, sf_dir), raw(spark, sf_dir), views.requests_any(spark, sf_dir))
    return _round(out.withColumn("rank", F.col("rank").cast("int")), ["final_score"])


def q_closest_rank_entities(spark, sf_dir):
    out = E.closest_by_rank(profile(spark, sf_dir), SIMULATED_RANK, 5)
    return _round(out.select("entity", "hec_rank", "rank_diff", "verdict"), ["hec_rank", "rank_diff"])


def q_entity_scaling(spark, sf_dir):
    st = E.scaling_stats(profile(spark, sf_dir))
    return _round(st, st.columns)


def q_nearest_entity(spark, sf_dir):
    return _round(E.nearest_entity(profile(spark, sf_dir), QUERY_POINT), ["hec_rank", "distance"])


def q_insights_top10(spark, sf_dir):
    out = E.top_lists(profile(spark, sf_dir), 10)
    return _round(out.withColumn("rank", F.col("rank").cast("int")), ["score", "hec_rank"])


QUERIES = {
    "entity_profile": q_entity_profile,
    "entity_departments": q_entity_departments,
    "department_domain": q_department_domain,
    "department_offer_flags": q_department_offer_flags,
    "advisor_top5": q_advisor_top5,
    "batch_recommendations": q_batch_recommendations,
    "batch_recommendations_any": q_batch_recommendations_any,
    "closest_rank_entities": q_closest_rank_entities,
    "entity_scaling": q_entity_scaling,
    "nearest_entity": q_nearest_entity,
    "insights_top10": q_insights_top10,
}

# ------------------------------------------------------------------ oracles
_KW = " OR ".join(f"contains(lower(a.entity), '{k}')" for k in FIXTURE_KEYWORDS)
PROFILE_SQL = f"""
SELECT a.entity, m.department, a.overall_score, a.research_score, a.teaching_score, a.hec_score,
       a.hec_rank, a.year_founded, CASE WHEN {_KW} THEN 'Public' ELSE 'Private' END AS type
FROM (SELECT entity, avg(overall_score) AS overall_score, avg(research_score) AS research_score,
             avg(teaching_score) AS teaching_score, avg(hec_score) AS hec_score, avg(hec_rank) AS hec_rank,
             avg(year_founded) AS year_founded
      FROM entities_raw WHERE entity IS NOT NULL GROUP BY entity) a
LEFT JOIN (SELECT entity, department FROM (
             SELECT entity, department, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, department) AS rn
             FROM entities_raw WHERE department IS NOT NULL GROUP BY entity, department) WHERE rn = 1) m
USING (entity)
"""
OFFERED_SQL = "SELECT DISTINCT entity, department FROM entities_raw WHERE department IS NOT NULL"
FIRST_DEPT = "(SELECT min(department) FROM entities_raw)"


def _pref_sql(pref: str) -> str:
    if pref == "Public":
        return "p.research_score + CASE WHEN p.type = 'Public' THEN 15.0E0 ELSE 0.0E0 END"
    if pref == "Private":
        return "p.teaching_score + CASE WHEN p.type = 'Private' THEN 15.0E0 ELSE 0.0E0 END"
    return "(p.research_score + p.teaching_score) / 2.0E0"


_P = {"profile": PROFILE_SQL}
_PO = {"profile": PROFILE_SQL, "offered": OFFERED_SQL}
_FEATS = ("overall_score", "research_score", "teaching_score", "hec_score")
_STATS = ", ".join(f"avg({f}) AS {f}_mean, stddev_pop({f}) AS {f}_std" for f in _FEATS)


def _r(cols):
    return ", ".join(f"round({c}, {R}) + 0.0E0 AS {c}" for c in cols)


def _z(f: str, value: str) -> str:
    return f"(({value}) - s.{f}_mean) / CASE WHEN s.{f}_std = 0 THEN 1.0E0 ELSE s.{f}_std END"


_DIST = " + ".join(f"power({_z(f, 'p.' + f)} - {_z(f, repr(QUERY_POINT[f]) + 'E0')}, 2)" for f in _FEATS)

def _recommendations_sql(requests: str) -> str:
    return with_views(f"""
SELECT request_id, CAST(rank AS INTEGER) AS rank, entity, round(final_score, {R}) + 0.0E0 AS final_score FROM (
  SELECT request_id, entity, final_score,
         row_number() OVER (PARTITION BY request_id ORDER BY final_score DESC, entity) AS rank FROM (
    SELECT r.request_id, p.entity,
           p.overall_score * (r.gpa / 4.0E0)
           + CASE r.preference WHEN 'Public' THEN {_pref_sql('Public')}
                               WHEN 'Private' THEN {_pref_sql('Private')}
                               ELSE {_pref_sql('Balanced')} END
           + CASE WHEN o.entity IS NOT NULL THEN 10.0E0 ELSE 0.0E0 END AS final_score
    FROM {requests} r CROSS JOIN profile p
    LEFT JOIN offered o ON o.entity = p.entity AND o.department = r.department))
WHERE rank <= 5""", "entities_raw", requests, extra=_PO)


ORACLES = {
    "entity_profile": with_views("SELECT * FROM profile", "entities_raw", extra=_P),
    "entity_departments": with_views("""
SELECT entity, string_agg(DISTINCT department, ', ' ORDER BY department) AS departments
FROM entities_raw GROUP BY entity""", "entities_raw"),
    "department_domain": with_views(
        "SELECT DISTINCT department FROM entities_raw WHERE department IS NOT NULL", "entities_raw"),
    "department_offer_flags": with_views(f"""
SELECT p.entity, p.type, p.overall_score, coalesce(f.offers, false) AS offers FROM profile p
LEFT JOIN (SELECT entity, bool_or(department = {FIRST_DEPT}) AS offers FROM entities_raw GROUP BY entity) f
USING (entity)""", "entities_raw", extra=_P),
    "advisor_top5": with_views(f"""
SELECT entity, type, offers, round(final_score, {R}) + 0.0E0 AS final_score FROM (
  SELECT p.entity, p.type, coalesce(f.offers, false) AS offers,
         p.overall_score * ({ADVISOR_GPA}E0 / 4.0E0) + {_pref_sql(ADVISOR_PREFERENCE)}
         + CASE WHEN coalesce(f.offers, false) THEN 10.0E0 ELSE 0.0E0 END AS final_score
  FROM profile p LEFT JOIN (SELECT entity, bool_or(department = {FIRST_DEPT}) AS offers
                            FROM entities_raw GROUP BY entity) f USING (entity))
ORDER BY final_score DESC, entity LIMIT 5""", "entities_raw", extra=_P),
    "batch_recommendations": _recommendations_sql("requests"),
    "batch_recommendations_any": _recommendations_sql("requests_any"),
    "closest_rank_entities": with_views(f"""
SELECT entity, {_r(['hec_rank', 'rank_diff'])},
       CASE WHEN rank_diff = 0 THEN 'perfect' WHEN rank_diff <= 3 THEN 'excellent'
            WHEN rank_diff <= 5 THEN 'good' ELSE 'error' END AS verdict
FROM (SELECT entity, hec_rank, abs(hec_rank - {SIMULATED_RANK}) AS rank_diff FROM profile
      ORDER BY rank_diff, entity LIMIT 5)""", "entities_raw", extra=_P),
    "entity_scaling": with_views(
        "SELECT " + ", ".join(f"round({f}_{s}, {R}) + 0.0E0 AS {f}_{s}" for f in _FEATS for s in ("mean", "std"))
        + f" FROM (SELECT {_STATS} FROM profile)", "entities_raw", extra=_P),
    "nearest_entity": with_views(f"""
SELECT entity, {_r(['hec_rank', 'distance'])} FROM (
  SELECT p.entity, p.hec_rank, sqrt({_DIST}) AS distance
  FROM profile p, (SELECT {_STATS} FROM profile) s
  ORDER BY distance, entity LIMIT 1)""", "entities_raw", extra=_P),
    "insights_top10": with_views(f"""
SELECT view, entity, type, {_r(['score', 'hec_rank'])}, CAST(rank AS INTEGER) AS rank FROM (
  SELECT 'overall' AS view, entity, type, overall_score AS score, hec_rank,
         row_number() OVER (ORDER BY overall_score DESC, entity) AS rank FROM profile
  UNION ALL SELECT 'public', entity, type, overall_score, hec_rank,
         row_number() OVER (ORDER BY overall_score DESC, entity) FROM profile WHERE type = 'Public'
  UNION ALL SELECT 'private', entity, type, overall_score, hec_rank,
         row_number() OVER (ORDER BY overall_score DESC, entity) FROM profile WHERE type = 'Private'
  UNION ALL SELECT 'research', entity, type, research_score, hec_rank,
         row_number() OVER (ORDER BY research_score DESC, entity) FROM profile)
WHERE rank <= 10""", "entities_raw", extra=_P),
}
