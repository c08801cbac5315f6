"""From raw documents to encoded training rows, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it left; ``run`` writes every stage's rows as Parquet in the cluster's
shared folder and reads them again.  All stages but the last return the
columns of documents.  The last returns the segmentations of each taken piece.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.minhash import deduplicated
from tessera.llm.mixing import mixed_documents
from tessera.llm.pieces import encoded
from tessera.llm.quality import without_poor
from tessera.llm.queries import piece_model
from tessera.llm.toxicity import without_toxic
from tessera.session import ensure_checkpoint_dir
from tessera.sources.tables import read_table

#: No stage but the third has rows that SQL can tell (scores, fitted models, random draws).
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 stay."""
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay that pass the base rules and are good more likely than not."""
    return without_poor(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8)."""
    return deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, as often as the sources' weights ask for."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every piece."""
    return encoded(docs, piece_model())


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
