"""Merkle manifest, spelling variants and substring dedup against brute force."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([_sha("".join(levels[-1][i: i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def _steps(levels, i):
    steps = []
    for level in levels[:-1]:
        run = i // 3 * 3
        steps.append(("".join(level[run: i]), "".join(level[i + 1: run + 3])))
        i //= 3
    return steps


def _manifest(rows):
    """Every row's (id, leaf, subroot, root, proof, folded root, verified), in a plain loop."""
    def leaf(r):
        return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    held = defaultdict(list)
    for r in rows:
        held[r[1]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(held, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([x[2] for x in sorted(held[s], key=lambda x: x[:3])]) for s in names}
    top = _tree([trees[s][-1][0] for s in names])
    out = []
    for j, s in enumerate(names):
        for i, (some, ident, digest, r) in enumerate(sorted(held[s], key=lambda x: x[:3])):
            steps, node = _steps(trees[s], i) + _steps(top, j), digest
            if some and r[4] is not None and zlib.crc32(str(ident).encode()) % 2 == 0:
                node = leaf((*r[:4], r[4].replace("\n", "")))
            for before, after in steps:
                node = _sha(before + node + after)
            out.append((r[0], digest, trees[s][-1][0], top[-1][0], _sha("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return out


def _altered():
    gone = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return {"text": F.when(gone, F.translate("text", "\n", "")).otherwise(F.col("text"))}


@pytest.mark.parametrize("height", [1, 2, 7])
def test_manifest_equals_a_plain_loop(documents, height):
    """Nulls, repeated rows, a null source; small superblocks give several levels of them."""
    from tessera.llm.merkle import manifest

    rows = [tuple(r) for r in documents.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = [tuple(r) for r in manifest(documents, altered=_altered(), height=height).collect()]
    assert sorted(map(str, found)) == sorted(map(str, _manifest(rows)))
    assert 0 < sum(r[-1] for r in found) < len(found)


def test_manifest_of_nothing_and_of_one(nothing, documents):
    from tessera.llm.merkle import manifest

    assert manifest(nothing).count() == 0
    one = manifest(documents.where("doc_id = 300")).first()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["verified"]
    assert one["proof_sha256"] == _sha("")


def _without_copied(rows, window):
    """(doc_id, words, words removed, kept text) of (doc_id, text), in a plain loop."""
    import re

    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - window + 1) if i is not None else ():
            g = tuple(w[k: k + window])
            least[g] = min(i, least.get(g, i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {j for k in range(len(w) - window + 1) if i is not None and least[tuple(w[k: k + window])] < i for j in range(k, k + window)}
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def _check_copied(frame, window, gram, keep=("doc_id",)):
    from tessera.llm.windows import without_copied

    rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    found = without_copied(frame, window=window, gram=gram, keep=list(keep)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, _without_copied(rows, window)))
    return sum(r["n_removed"] for r in found)


@pytest.mark.parametrize(("window", "gram"), [(13, 3), (5, 2), (4, 4)])
def test_copied_passages_equal_a_plain_loop(documents, window, gram):
    assert _check_copied(documents, window, gram) > 0


def test_frequent_minimisers_give_the_same(documents, monkeypatch):
    """Nearly every window goes alone, and texts are shuffled to their spans."""
    from tessera.llm import windows

    for name, value in (("SAMPLE", 1.0), ("LEAST_FREQUENT", 2), ("SENT_SPANS", 0)):
        monkeypatch.setattr(windows, name, value)
    frame = documents.select("doc_id", F.substring("text", 1, 3000).alias("text"))
    assert _check_copied(frame, 6, 2) > 0


def test_passages_in_repetitive_and_odd_texts(spark):
    rows = [(1, "a " * 900), (2, "b " + "a " * 700 + "c"), (3, "a a a"), (4, "\u3000x é\x00 " * 20), (5, "q " + "\u3000x\té\x00\n" * 20), (2, "a " * 14), (None, "a " * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _check_copied(frame, 13, 3) > 0


def test_one_hash_for_different_windows_is_told_apart():
    import numpy as np

    from tessera.llm.windows import same_windows

    data = np.frombuffer(b"one two one six", np.uint8)
    same = same_windows(data, np.array([0, 4, 8, 12]), np.array([3, 7, 11, 15]), np.zeros(4, np.uint64))
    assert same[0] == same[2] and len({same[0], same[1], same[3]}) == 3


def test_copied_passages_of_nothing_and_extra_columns(nothing, documents):
    from tessera.llm.windows import without_copied

    assert without_copied(nothing).columns == [*nothing.columns, "n_words", "n_removed", "kept"]
    assert without_copied(nothing).count() == 0
    clashing = documents.withColumn("kept", F.lit("own")).withColumn("a.b", F.lit(1))
    assert without_copied(clashing).where("kept = 'own' and `a.b` = 1 and _kept is not null").count() == documents.count()


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def _variants(counts, factor=2):
    out = set()
    form = {}
    near = {w: [o for o in counts if _one_edit(w, o)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, n, form[w], counts.get(form[w]), len(near[w]), root))
    return out


def _some_words(spark):
    import random

    rng = random.Random(4)
    words = set()
    while len(words) < 260:
        w = "".join(rng.choice("ab\u00e9c") for _ in range(rng.choice([5, 6, 7, 9])))
        words.add(w)
    words |= {"\u00c9cole" + "x" * 40, "\u00e9cole" + "x" * 40, "x" * 50_000, "x" * 50_001}
    return {w: rng.choice([3, 4, 8, 9, 30, 31, 100, 400]) for w in sorted(words)}


@pytest.mark.parametrize("common", [200, 2])
def test_variants_equal_all_pairs(spark, monkeypatch, common):
    """Few letters, so that many words are near; with a small limit nearly all chunks are cut again."""
    from tessera.llm import spelling

    monkeypatch.setattr(spelling, "COMMON", common)
    counts = _some_words(spark)
    found = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {(r["word"], r["n"], r["form"], r["form_n"], r["n_near"], r["root"]) for r in found.collect()} == _variants(counts)


def test_words_of_documents(documents, nothing):
    import re
    from collections import Counter

    from tessera.llm.spelling import spelling_variants

    counts = Counter()
    for r in documents.select("doc_id", "text").collect():
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", r["text"] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            if h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 2 and n >= 3}
    found = spelling_variants(documents, least_length=2, dropped=7).collect()
    assert {(r["word"], r["n"], r["form"], r["form_n"], r["n_near"], r["root"]) for r in found} == _variants(counts)
    assert spelling_variants(nothing).count() == 0
