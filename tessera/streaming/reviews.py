"""Review scoring on Structured Streaming.

The reference has no streaming dataflow (no watermark, window or state).
What carries over is that the row-local text operators (tokens, lexicon and
rating sentiment, keyword class, equality filters, search) are plain column
expressions, so the same code scores a stream of incoming review files.

Fault tolerance: the query's progress lives in a checkpoint location under
the session's ``spark.checkpoint.dir`` (a shared folder on a cluster), so a
restarted query resumes where it stopped and the file sink stays
exactly-once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import ensure_checkpoint_dir
from tessera.sources.tables import read_table

REVIEW_VIEW_COLS = ("doc_id", "text", "source", "n_chars")


def document_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """Stream the documents table's parquet file(s) with its batch schema."""
    schema = read_table(spark, sf_dir, "documents").schema
    return (spark.readStream.schema(schema)
                 .option("pathGlobFilter", "documents*.parquet")
                 .option("maxFilesPerTrigger", files_per_trigger)
                 .parquet(sf_dir))


def score_reviews(stream: DataFrame, text: str = "text") -> DataFrame:
    """Row-local scoring: tokens -> lexicon sentiment, plus the rating rule
    when a rating column is present."""
    toks = T.tokens(text)
    cols = {k: v for k, v in T.text_sentiment(toks).items()}
    out = stream.select("*", *[v.alias(k) for k, v in cols.items()])
    if "rating" in stream.columns:
        out = out.withColumns(T.rating_sentiment(F.col("rating")))
    return out


def start(scored: DataFrame, name: str, path: str, sink: str = "parquet", available_now: bool = True):
    """Start a query that writes files under ``path``, with its checkpoint under
    the session checkpoint dir."""
    spark = scored.sparkSession
    base = ensure_checkpoint_dir(spark)
    w = (scored.writeStream.queryName(name).outputMode("append")
               .option("checkpointLocation", f"{base.rstrip('/')}/stream-{name}"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.format(sink).option("path", path).start()
