"""Registered queries of the small rules (F1, F16-F18, F21, V2) and of the CSV
contract (IO1, IO6), each with a DuckDB oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import numeric, vectors
from tessera.functions.dates import parse_date
from tessera.session import ensure_checkpoint_dir
from tessera.sources import contracts, sinks, views
from tessera.sources.tables import read_table
from tessera.sources.views_sql import VECTOR_SETS

R = 6


def q_numeric_rules(spark, sf_dir) -> DataFrame:
    """F16 truncation, F17 half-even rounding, F18 difference, F21 agreement."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    models = F.col("p_size") % 3, (F.col("p_partkey") % 3).cast("int"), F.lit(1)
    return p.select("p_partkey", numeric.truncate_int(F.col("p_retailprice") / 7.0 - 180.0).alias("truncated"),
                    numeric.round_half_even(F.col("p_size") / 8.0, 2).alias("rounded"), numeric.abs_diff("p_size", F.lit(25)).cast("bigint").alias("diff"),
                    *[v.cast("bigint" if k != "all_agree" else "boolean").alias(k) for k, v in numeric.agreement(*models).items()])


def q_scaled_vectors(spark, sf_dir) -> DataFrame:
    """V2."""
    v = views.vector_sets(spark, sf_dir)
    return v.select("grp", "ord", F.transform(vectors.scale("vec", 0.5), lambda x: F.round(x, R) + F.lit(0.0)).alias("half"))


def q_parsed_dates(spark, sf_dir) -> DataFrame:
    """F1 on good, bad, empty and missing date texts."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("d"))
    text = F.when(F.col("o_orderkey") % 4 == 1, F.lit("not a date")).when(F.col("o_orderkey") % 4 == 2, F.lit("")) \
        .when(F.col("o_orderkey") % 4 == 3, F.lit(None).cast("string")).otherwise(F.col("d"))
    return o.select("o_orderkey", parse_date(text).alias("parsed"))


def q_csv_round_trip(spark, sf_dir) -> DataFrame:
    """IO6 then IO1: a table written as CSV and read with its declared schema."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(s, path)
    return contracts.read_csv(spark, path, "s_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal double")


def _awkward_reviews(spark, sf_dir) -> DataFrame:
    """Texts with quotes, commas, line ends, blanks around them, and empty and missing ones; some ratings are no numbers."""
    d = F.col("doc_id")
    text = F.when(d % 7 == 0, F.concat(F.lit('say "'), "source", F.lit('", "'))).when(d % 7 == 1, F.concat(F.lit("two\nlines, "), "lang")) \
        .when(d % 7 == 2, F.lit("")).when(d % 7 == 3, F.lit(None).cast("string")).when(d % 7 == 4, F.concat(F.lit("  back\\slash\\ "), "source", F.lit(" "))) \
        .otherwise(F.substring("text", 1, 200))
    rating = F.when(d % 11 == 0, F.lit("many")).when(d % 11 == 1, F.lit("")).otherwise((d % 5 + 1).cast("string"))
    return read_table(spark, sf_dir, "documents").select("doc_id", rating.alias("Rating"), text.alias("review_text"))


def _written(spark, df: DataFrame) -> str:
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(df, path)
    return path


def q_review_csv_round_trip(spark, sf_dir) -> DataFrame:
    """IO6 then IO1 with awkward texts; the schema lists the columns in another order than the file."""
    path = _written(spark, _awkward_reviews(spark, sf_dir))
    return contracts.read_csv(spark, path, "review_text string, rating int, doc_id bigint")


def q_review_csv_rejects(spark, sf_dir) -> DataFrame:
    """IO1 + IO4: rows that fit the declared schema, and why the others were set aside."""
    path = _written(spark, _awkward_reviews(spark, sf_dir))
    good, bad = contracts.read_csv_rejects(spark, path, "review_text string, rating int, doc_id bigint", required=("review_text",))
    aside = bad.select(F.get_json_object("row_text", "$.doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("int").alias("rating"), "reason")
    return good.select("doc_id", "rating", F.lit(None).cast("string").alias("reason")).union(aside)


QUERIES = {
    "review_csv_round_trip": q_review_csv_round_trip,
    "review_csv_rejects": q_review_csv_rejects,
    "numeric_rules": q_numeric_rules,
    "scaled_vectors": q_scaled_vectors,
    "parsed_dates": q_parsed_dates,
    "csv_round_trip": q_csv_round_trip,
}

_AWKWARD = """(
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'many' WHEN doc_id % 11 = 1 THEN '' ELSE (doc_id % 5 + 1)::VARCHAR END AS rating,
       CASE doc_id % 7 WHEN 0 THEN 'say "' || source || '", "' WHEN 1 THEN 'two' || chr(10) || 'lines, ' || lang WHEN 2 THEN '' WHEN 3 THEN NULL
                       WHEN 4 THEN '  back' || chr(92) || 'slash' || chr(92) || ' ' || source || ' ' ELSE substr(text, 1, 200) END AS review_text
FROM documents)"""
_REASON = """concat_ws(', ', CASE WHEN trim(coalesce(review_text, '')) = '' THEN 'review_text missing' END,
                 CASE WHEN rating = 'many' THEN 'rating is no int' END)"""

ORACLES = {
    "review_csv_round_trip": f"SELECT review_text, TRY_CAST(rating AS INTEGER) AS rating, doc_id FROM {_AWKWARD}",
    "review_csv_rejects": f"""
SELECT doc_id, CASE WHEN {_REASON} = '' THEN TRY_CAST(rating AS INTEGER) END AS rating, CASE WHEN {_REASON} <> '' THEN {_REASON} END AS reason FROM {_AWKWARD}""",
    "numeric_rules": """
SELECT p_partkey, CAST(trunc(p_retailprice / 7.0E0 - 180.0E0) AS INTEGER) AS truncated, round_even(p_size / 8.0E0, 2) AS rounded,
       CAST(abs(p_size - 25) AS BIGINT) AS diff, CAST(least(a, b, 1) AS BIGINT) AS pred_min, CAST(greatest(a, b, 1) AS BIGINT) AS pred_max,
       CAST(greatest(a, b, 1) - least(a, b, 1) AS BIGINT) AS pred_spread, a = b AND b = 1 AS all_agree
FROM (SELECT *, p_size % 3 AS a, p_partkey % 3 AS b FROM part)""",
    "scaled_vectors": f"""
SELECT grp, ord, list_transform(vec, lambda x: round(x * 0.5E0, {R}) + 0.0E0) AS half FROM ({VECTOR_SETS.strip()})""",
    "parsed_dates": """
SELECT o_orderkey, TRY_CAST(CASE o_orderkey % 4 WHEN 1 THEN 'not a date' WHEN 2 THEN '' WHEN 3 THEN NULL
                            ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS DATE) AS parsed FROM orders""",
    "csv_round_trip": "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier",
}
