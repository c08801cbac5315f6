"""The pipeline's stages on sf0.001, each against its operator or brute force."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages(spark, tmp_path):
    from tessera.llm.quality import quality
    from tessera.llm.toxicity import toxicity
    from tessera.sources.tables import read_table
    from tests.llm.test_sets import _components, _targets

    docs = read_table(spark, SF_SMALL, "documents")
    columns, frames = docs.columns, [docs]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "mix", "encode"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF_SMALL).write.parquet(str(tmp_path / f"{k}"))
        frames.append(spark.read.parquet(str(tmp_path / f"{k}")))
        assert frames[-1].columns == columns or name == "encode"
    ids = [sorted(r["doc_id"] for r in f.select("doc_id").collect()) for f in frames[:4]]

    scored = toxicity(docs, read_table(spark, SF_SMALL, "labels"), keep=["doc_id"])
    assert ids[1] == sorted(r["doc_id"] for r in scored.where("score < 0.7").collect())
    assert ids[2] == sorted(r["doc_id"] for r in quality(frames[1], keep=["doc_id"]).where("kept").collect())

    rows = [(r["doc_id"], r["text"]) for r in frames[2].collect()]
    sets, roots = _components(rows, 5, 80)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    assert ids[3] == sorted(least.values())

    texts = {r["doc_id"]: r["text"] for r in frames[3].collect()}
    sizes, got = {}, {}
    for r in frames[3].collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(_words(r["text"]))
    for r in frames[4].collect():
        assert r["text"] in texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
        got[r["source"]] = got.get(r["source"], 0) + len(_words(r["text"]))
    targets = _targets(sizes)
    assert all(abs(got.get(s, 0) - targets[s]) <= 1024 for s in targets)

    last = frames[5]
    assert last.where(~F.col("round_trip")).count() == 0
    assert last.where("sample = 1").count() == frames[4].count()
    assert corpus_pipeline.run(spark, SF_SMALL).count() == last.count()
