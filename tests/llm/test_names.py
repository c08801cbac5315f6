"""Columns whose names hold dots and back quotes pass through every operator."""

import pytest
from pyspark.sql import functions as F

ODD = ("a.b", "rate`s", "text.of")


@pytest.fixture(scope="module")
def named(documents):
    some = documents.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 309 or doc_id is null")
    return some.select("*", *[F.lit(f"own {c}").alias(c) for c in ODD]).cache()


def _kept(frame):
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in ODD]
    return {tuple(r) for r in frame.select(*quoted).distinct().collect()} == {tuple(f"own {c}" for c in ODD)}


@pytest.mark.parametrize("apply", ["quality", "without_poor", "deduplicated", "mixed_documents", "licenses", "shuffled", "without_copied"])
def test_documents(named, apply):
    from tessera.llm.licenses import licenses
    from tessera.llm.minhash import deduplicated
    from tessera.llm.mixing import mixed_documents
    from tessera.llm.quality import quality, without_poor
    from tessera.llm.sharding import shuffled
    from tessera.llm.windows import without_copied

    call = {"quality": quality, "without_poor": without_poor, "deduplicated": deduplicated, "mixed_documents": mixed_documents, "licenses": licenses,
            "shuffled": lambda d: shuffled(d, 3), "without_copied": without_copied}[apply]
    assert _kept(call(named))


def test_toxicity(spark, named):
    from tessera.llm.toxicity import without_toxic

    labels = spark.createDataFrame([(i, 0, int(i % 2 == 0)) for i in range(12)], "doc_id long, quality int, toxic int")
    assert _kept(without_toxic(named, labels, limit=1.1))


def test_pieces(named):
    from tessera.llm.pieces import encoded
    from tessera.llm.queries import piece_model

    assert _kept(encoded(named, piece_model()))


def test_pages(spark):
    from tessera.llm.htmltext import extracted
    from tessera.llm.urlfilter import judged

    pages = spark.createDataFrame([(1, "http://a.org/x", "<article><p>one</p></article>")], "page_id long, url string, html string")
    pages = pages.select("*", *[F.lit(f"own {c}").alias(c) for c in ODD])
    assert _kept(judged(pages))
    assert _kept(extracted(pages))
