"""Logical inputs of the four workloads, derived from the driver tables.

Each view maps the star schema onto the column contract the reference's
applications consume (sales_raw, reviews, entities_raw, requests,
vector_sets).  The SQL text of the same views lives in ``views_sql`` and is
used verbatim by the DuckDB oracles.

Scale notes
-----------
* ``sales`` joins lineitem to part and supplier.  part and supplier grow
  with the data, so their joins are left to the planner (sort-merge, or a
  broadcast AQE chooses from runtime sizes).  nation (25 rows) and region
  (5 rows) have a fixed size by the schema's definition and are broadcast.
* Only the columns each view needs are selected, so the parquet scans read
  a pruned ``ReadSchema``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import read_table

# The review phrase appended per doc_id % 6 (FIXTURES.md B),
# in order 0..5; 5 appends nothing.
REVIEW_PHRASES = (
    " Great quality, highly recommend.",
    " Terrible. Broke, waste of money!",
    " Partly bad and partly great.",
    " Excellent and reliable, but slow.",
    " Nothing to add.",
    "",
)

# Request department per c_nationkey % 6 (FIXTURES.md B).
REQUEST_DEPARTMENTS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def _case(key: Column, values) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(key == i, F.lit(v)) if expr is None else expr.when(key == i, F.lit(v))
    return expr


def supplier_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> region name ("store").  nation/region are fixed-size."""
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (supp.join(F.broadcast(nation), supp.s_nationkey == nation.n_nationkey)
                .join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
                .select("s_suppkey", F.col("r_name").alias("store")))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sales_raw: date, store, product, sales_qty, promotion, price."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    stores = supplier_store(spark, sf_dir)
    d = F.col("l_shipdate").cast("date")
    promo = ((F.month(d) * 7 + F.length("store") + F.length("p_type")) % 5 == 0).cast("int")
    return (li.join(part, li.l_partkey == part.p_partkey)
              .join(stores, li.l_suppkey == stores.s_suppkey)
              .select(d.alias("date"), F.col("store"), F.col("p_type").alias("product"),
                      F.col("l_quantity").cast("int").alias("sales_qty"),
                      promo.alias("promotion"),
                      F.col("p_retailprice").alias("price")))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reviews: doc_id, review_text, rating, category, helpful_votes."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    phrase = _case(F.col("doc_id") % 6, REVIEW_PHRASES)
    rating = F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("int")).otherwise(
        (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select(
        "doc_id",
        F.concat(F.col("text"), phrase).alias("review_text"),
        rating.alias("rating"),
        F.col("source").alias("category"),
        (F.col("n_chars") % 10).cast("int").alias("helpful_votes"))


def entities_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entities_raw: one row per (entity, department) record."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    k = F.col("p_partkey")
    return p.select(
        F.col("p_name").alias("entity"),
        F.col("p_type").alias("department"),
        (50 + F.col("p_size")).cast("int").alias("overall_score"),
        (50 + k * 7 % 51).cast("int").alias("research_score"),
        (50 + k * 13 % 51).cast("int").alias("teaching_score"),
        (50 + k * 29 % 51).cast("int").alias("hec_score"),
        (1 + k * 17 % 70).cast("int").alias("hec_rank"),
        (1900 + k % 120).cast("int").alias("year_founded"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requests: request_id, gpa (2.0..4.0 step 0.1), preference, department."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    key = F.col("c_custkey")
    pref = _case(key % 3, ("Balanced", "Public", "Private"))
    return c.select(
        key.alias("request_id"),
        (F.lit(2.0) + (key % 21) / F.lit(10.0)).alias("gpa"),
        pref.alias("preference"),
        _case(F.col("c_nationkey") % 6, REQUEST_DEPARTMENTS).alias("department"))


def requests_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests off the form's grid: any GPA, unknown and NULL preferences and departments."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    key = F.col("c_custkey")
    return c.select(
        key.alias("request_id"),
        (F.lit(2.0) + (key % 97) / F.lit(48.0)).alias("gpa"),
        _case(key % 5, ("Balanced", "Public", "Private", "Any")).alias("preference"),
        F.when(key % 7 == 0, F.lit(None).cast("string")).when(key % 7 == 1, F.lit("NONE"))
         .otherwise(_case(F.col("c_nationkey") % 6, REQUEST_DEPARTMENTS)).alias("department"))


def vector_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vector_sets: grp (label), ord (vec_id), vec array<double>."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("grp"), F.col("vec_id").alias("ord"),
                    F.col("embedding").cast("array<double>").alias("vec"))


def short_vector_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vector_sets with the first 8 components: many more rows than dimensions,
    and every 40th order NULL group, so later rounds and NULL keys are checked."""
    v = vector_sets(spark, sf_dir)
    return v.select(F.when(F.col("ord") % 40 != 0, F.col("grp")).alias("grp"), "ord", F.slice("vec", 1, 8).alias("vec"))
