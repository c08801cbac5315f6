"""Contracts (IO1-IO5, P7), sinks (IO6-IO8) and streaming."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import display
from tessera.sources import contracts, sinks
from tessera.streaming import reviews as stream_reviews
from tests.conftest import SF_SMALL


def test_header_normalise_alias_require_defaults(spark):
    df = spark.createDataFrame([("x", 1)], "` Review `: string, `Helpful Votes`: int")
    out = contracts.normalise_headers(df)
    assert out.columns == ["review", "helpful_votes"]
    out = contracts.review_contract(spark.createDataFrame([("good",)], "Comment string"))
    assert out.columns == ["review_text", "category", "rating", "helpful_votes"]
    r = out.first()
    assert (r.category, r.rating, r.helpful_votes) == ("General", 3, 0)


def test_alias_never_duplicates(spark):
    df = spark.createDataFrame([("a", "b")], "review string, review_text string")
    assert contracts.alias_first(df, "review_text").columns == ["review", "review_text"]


def test_required_columns_raise_before_any_job(spark):
    with pytest.raises(ValueError, match="sales_qty"):
        contracts.sales_contract(spark.createDataFrame([("2020-01-01", "p")], "date string, product string"))


def test_min_rows_guard(spark):
    with pytest.raises(ValueError):
        contracts.min_rows(spark.range(5), 20)
    assert contracts.min_rows(spark.range(50), 20).count() == 50


def test_all_sentinel_filter(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "store string, product string")
    assert display.filter_equals(df, {"store": "All Stores", "product": None}).count() == 2
    assert display.filter_equals(df, {"store": "a", "product": "All Products"}).count() == 1


def test_csv_and_csv_read_round_trip(spark):
    out = tempfile.mkdtemp(prefix="tessera-csv-")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    sinks.write_csv(df, out + "/t")
    back = contracts.read_csv(spark, out + "/t", "id int, v string")
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a"), (2, "b")]


def test_json_summary(spark):
    out = tempfile.mkdtemp(prefix="tessera-json-")
    from tessera.plans import panel_queries
    m = panel_queries.monthly(spark, SF_SMALL)
    comp = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "model string, mape double")
    summ = sinks.summary_frame(m, comp, "A")
    sinks.write_json_summary(summ, out + "/s")
    files = [f for f in os.listdir(out + "/s") if f.endswith(".json")]
    data = json.loads(open(os.path.join(out, "s", files[0])).readline())
    assert data["best_model"] == "A" and len(data["models"]) == 2
    assert data["dataset"]["rows"] == m.count()


def test_stream_scoring_equals_batch(spark, tmp_path):
    from tessera.functions import text as T
    from tessera.sources.tables import read_table
    docs = read_table(spark, SF_SMALL, "documents")
    scored = stream_reviews.score_reviews(stream_reviews.document_stream(spark, SF_SMALL))
    q = stream_reviews.start(scored.select("doc_id", "text_sentiment", "pos_hits", "neg_hits"),
                             f"reviews_{os.getpid()}", str(tmp_path / "scored"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "scored"))
    ts = T.text_sentiment(T.tokens(F.col("text")))
    want = docs.select("doc_id", ts["text_sentiment"].alias("text_sentiment"),
                       ts["pos_hits"].alias("pos_hits"), ts["neg_hits"].alias("neg_hits"))
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_parse_date_handles_text_and_garbage(spark):
    from tessera.functions.dates import parse_date
    df = spark.createDataFrame([("2023-06-01",), ("2023-06-01 10:00:00",), ("not a date",), (None,)], "d string")
    got = [r[0] for r in df.select(parse_date("d")).collect()]
    import datetime as dt
    assert got == [dt.date(2023, 6, 1), dt.date(2023, 6, 1), None, None]


def test_export_predictions_round_trip(spark):
    out = tempfile.mkdtemp(prefix="tessera-pred-")
    df = spark.createDataFrame([("2023-07-01", "s", "p", 10.0, 12.5)],
                               "date string, store string, product string, actual double, predicted double")
    sinks.export_predictions(df, out + "/p")
    back = contracts.read_csv(spark, out + "/p", "date string, store string, product string, "
                                                 "actual double, predicted double")
    assert back.first().predicted == 12.5
