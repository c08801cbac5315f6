"""Quality rules, toxicity, licenses and pieces against brute force."""

import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_measures_and_verdicts(documents):
    from tessera.llm.quality import quality

    rows = quality(documents, keep=["doc_id", "text", "votes"]).collect()
    assert len(rows) == documents.count()
    for r in rows:
        w, text = _words(r["text"]), r["text"] or ""
        windows = Counter(zip(w, w[1:], w[2:]))
        again = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if windows[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["good"] <= 1 and r["votes"] == "own votes"


def test_quality_of_nothing(nothing):
    from tessera.llm.quality import quality, without_poor

    assert quality(nothing).count() == 0
    assert without_poor(nothing).columns == nothing.columns


def test_expectation_maximisation_finds_the_accuracies(spark):
    """Votes drawn from known accuracies; compared with a plain loop and with the truth."""
    import random

    from tessera.llm.quality import PSEUDO_VOTES, START, STEPS, fit

    rng = random.Random(1)
    truth = [(0.97, 0.4), (0.95, 0.3), (0.99, 0.6), (0.9, 0.5)]
    counts = Counter()
    for _ in range(20000):
        good = rng.random() < 0.8
        counts[tuple(0 if rng.random() < 0.2 else 1 if rng.random() < (p if good else q) else -1 for p, q in truth)] += 1
    share, odds = fit(spark.createDataFrame([(list(v), n) for v, n in counts.items()], "v array<tinyint>, n long"), 4)
    s, o = 0.8, [START] * 4
    for _ in range(STEPS):
        weights = {}
        for v in counts:
            a, b = s, 1 - s
            for x, (p, q) in zip(v, o, strict=True):
                a, b = a * (p if x == 1 else 1 - p if x else 1), b * (q if x == 1 else 1 - q if x else 1)
            weights[v] = a / (a + b)
        new = []
        for j in range(4):
            side = []
            for start, w in ((START[0], weights), (START[1], {v: 1 - x for v, x in weights.items()})):
                side.append((sum(n * w[v] for v, n in counts.items() if v[j] == 1) + start * PSEUDO_VOTES)
                            / (sum(n * w[v] for v, n in counts.items() if v[j]) + PSEUDO_VOTES))
            new.append(tuple(side))
        s, o = sum(n * weights[v] for v, n in counts.items()) / sum(counts.values()), new
    assert abs(share - s) < 1e-6 and all(abs(a - b) < 1e-6 for x, y in zip(odds, o, strict=True) for a, b in zip(x, y, strict=True))
    assert abs(share - 0.8) < 0.05 and all(abs(a - b) < 0.1 for x, y in zip(odds, truth, strict=True) for a, b in zip(x, y, strict=True))


@pytest.fixture(scope="session")
def labelled(spark):
    import random

    rng = random.Random(7)
    plain = [a + b + c for a in "bdfgklmnpr" for b in "aeiou" for c in ("st", "nd", "rk", "lt", "mp", "ss")]
    bad = ["vile", "rotten", "nasty"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        w = [rng.choice(plain) for _ in range(rng.randint(40, 120))]
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        if i % 5:
            labels.append((i, 1, int(toxic)))
    rows += [(None, "bast vile"), (5000, None), (5001, ""), (5002, " .. "), (3, rows[3][1])]
    labels += [(None, 1, 1), (7, None, None), (1, 0, 0)]
    return (spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("own")).withColumn("score", F.lit("own")).cache(),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache())


def test_toxicity_on_held_out_documents(labelled):
    from tessera.llm.toxicity import toxicity

    docs, labels = labelled
    rows = toxicity(docs, labels, keep=["doc_id", "text"], score_col="score").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 900 and crc32(str(r["doc_id"]).encode()) % 3 == 1]
    caught = [r["score"] >= 0.7 for r in held if r["doc_id"] % 6 == 0]
    false = [r["score"] >= 0.7 for r in held if r["doc_id"] % 6]
    assert sum(caught) >= 0.9 * len(caught) and sum(false) <= 0.02 * len(false)
    empty = {r["score"] for r in rows if not (r["text"] or "").strip(" .")}
    assert len(empty) == 1


def test_toxic_expressions_of_ordinary_words(spark):
    import random

    from tessera.llm.toxicity import toxicity

    rng, plain = random.Random(8), [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(1200):
        w = [rng.choice(plain) for _ in range(rng.randint(40, 80))]
        for _ in range(2):  # both words are as common in ordinary texts, but apart
            w[rng.randrange(0, 19):0] = ["green"]
            w[rng.randrange(21, 39):0] = ["door"]
        if i % 4 == 0:
            for _ in range(2):
                w += [rng.choice(plain), "door", rng.choice(plain), "green", "door"]
        else:
            w += ["green", rng.choice(plain), "door", rng.choice(plain), "green"]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    scored = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    held = [(r["doc_id"] % 4 == 0, r["score"] >= 0.5) for r in scored.collect() if crc32(str(r["doc_id"]).encode()) % 3 == 1]
    caught, false = ([s for t, s in held if t == toxic] for toxic in (True, False))
    assert sum(caught) >= 0.9 * len(caught) and sum(false) <= 0.05 * len(false)


def test_a_text_that_repeats_itself_teaches_its_pairs_once(spark):
    import pyarrow as pa

    from tessera.llm.toxicity import _count

    batch = pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array(["so so so so so so", "so so"])], names=["toxic", "text"])
    assert sorted(n for out in _count([batch]) for n in out.column(2).to_pylist()) == [2, 2]


def test_copies_do_not_raise_the_pair_limit(spark):
    from tessera.llm.toxicity import calibration_part, fit_counts, training_fold

    ids = [r["id"] for r in spark.range(3000).where(training_fold(F.col("id")) & ~calibration_part(F.col("id"))).orderBy("id").limit(600).collect()]
    # 40 toxic texts, 12 ordinary ones with "red car", and one ordinary text copied over and over
    rows = [(i, "bad " + "x" * (k + 1) if k < 40 else "red car " + "y" * k if k < 52 else "copy") for k, i in enumerate(ids)]
    labels = spark.createDataFrame([(i, int(k < 40)) for k, i in enumerate(ids)], "doc_id long, toxic int")
    counts = fit_counts(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    # 80 toxic and 37 ordinary pairs of distinct texts: the limits are 2.2 and 1
    assert sum(r["s"] for r in counts) == 80 and sum(r["t"] for r in counts) == 37
    assert 12 in [r["y"] for r in counts if r["kind"] == 1]


def test_joined_scores_equal_the_sent_ones(labelled):
    from tessera.llm.toxicity import toxicity

    docs, labels = labelled
    sent, joined = ({(r["doc_id"], r["text"]): r["s"] for r in toxicity(docs, labels, score_col="s", sent_entries=n).collect()} for n in (10**6, 0))
    assert sent.keys() == joined.keys() and all(abs(sent[k] - joined[k]) < 1e-9 for k in sent)


def test_toxicity_without_labels_or_rows(labelled, nothing):
    from tessera.llm.toxicity import toxicity, without_toxic

    docs, labels = labelled
    assert toxicity(docs, labels.where("false")).select("score").count() == docs.count()
    assert toxicity(nothing, labels).count() == 0
    assert without_toxic(docs, labels).columns == docs.columns


def test_licenses(documents, nothing):
    from tessera.llm.licenses import PHRASES, licenses

    rows = licenses(documents, keep=["doc_id", "text", "score"]).collect()
    assert len(rows) == documents.count()
    for r in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or ""))
        at = [(i, x) for p, x in PHRASES.items() for i in range(len(w)) if w[i: i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == (min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        if r["doc_id"] == 308:
            assert r["_labels"] == "cc-by,cc-by-nc-4.0,mit,reserved" and r["_score"] == 1.0
    assert licenses(nothing).count() == 0


def test_license_with_words_put_in_and_left_out(spark):
    from tessera.llm.licenses import TEMPLATES, licenses, license_spans, scanned

    text = TEMPLATES[1][1].split()
    changed = text[:20] + ["indeed"] + text[20:40] + text[42:]
    docs = spark.createDataFrame([(1, "before " + " ".join(changed) + " after"), (2, " ".join(text[:25])), (3, " ".join(reversed(text)))], "doc_id long, text string")
    found = {r["doc_id"]: r["labels"] for r in licenses(docs).collect()}
    assert found == {1: "mit", 2: "", 3: ""}
    scan, rid = scanned(docs, keep=["doc_id"])
    span = license_spans(scan, rid).collect()
    assert len(span) == 1 and span[0]["start"] == 1 and span[0]["end"] == 1 + len(re.findall(r"[a-z0-9]+", " ".join(changed).lower()))


@pytest.fixture(scope="session")
def model():
    P = pytest.importorskip("public_tokenizers")
    return P.path("piece_bpe_32k.model")


def test_pieces_round_trip(documents, nothing, model):
    from tessera.llm.pieces import decoded, encoded

    rows = encoded(documents, model, samples=3, keep=["doc_id", "text", "sample"])
    found = decoded(rows, model, text_col="back").collect()
    assert all(r["back"] == (r["text"] or "") and r["round_trip"] and r["n_pieces"] == len(r["piece_ids"]) for r in found)
    by = Counter((r["doc_id"], r["text"], tuple(r["piece_ids"])) for r in found)
    copies = Counter((r["doc_id"], r["text"]) for r in documents.collect())
    assert all(n == copies[k[:2]] for k, n in by.items())  # distinct within a row, equal between repeated rows
    assert {r["_sample"] for r in found} == {1, 2, 3}
    assert encoded(nothing, model).count() == 0


def test_pieces_are_drawn_without_replacement(model):
    """First draws follow the path probabilities, and inclusion scores make unbiased sums."""
    import numpy as np

    from tessera.llm import pieces as X

    voc = X.vocabulary(model, 0.5)
    n, text = 4000, b"there"
    keys = X.W.mix(np.arange(1, n + 1, dtype=np.uint64))
    data = np.frombuffer(text * n, np.uint8)
    part = X.Slice(data, np.arange(n + 1) * len(text), keys, voc)
    first, weight, prob = Counter(), Counter(), {}
    for found in part.sample(3):
        assert [g for _, _, g, _ in found] == sorted((g for _, _, g, _ in found), reverse=True)
        for k, (edges, p, _, share) in enumerate(found):
            ids = tuple(part.ids(edges))
            prob[ids] = np.exp(p)
            first[ids] += k == 0
            weight[ids] += prob[ids] / share
    likely = [i for i in prob if prob[i] > 0.02]
    assert len(likely) >= 3 and sum(prob.values()) < 1 + 1e-9
    for ids in likely:
        assert abs(first[ids] / n - prob[ids]) < 5 * (prob[ids] * (1 - prob[ids]) / n) ** 0.5
        assert abs(weight[ids] / n - prob[ids]) < 0.1 * prob[ids] + 0.01


def test_edges_are_the_pieces_and_no_span_is_looked_up_that_no_piece_begins_with(model, monkeypatch):
    import random

    import numpy as np

    from tessera.llm import pieces as X

    voc = X.vocabulary(model, 1.0)
    pieces = {voc.bytes_of[i] for i in voc.ids}
    rng = random.Random(7)
    units = [b" the", b" straightforwardly", " naïve".encode(), "世界\U0001f600".encode(), b"\n", b"   ", b"\xc3\xa9\x80a", b" x" * 3,
             *[bytes(rng.choice(b"etaoinshrdlu") for _ in range(rng.randint(1, 60))) for _ in range(200)]]
    asked, find = [], X.Vocabulary.find
    monkeypatch.setattr(X.Vocabulary, "find", lambda self, values: asked.append(len(values)) or find(self, values))
    data = np.frombuffer(b"".join(units), np.uint8)
    lattice = X.Lattice(data, np.cumsum([len(u) for u in units]), voc)
    want, at = set(), 0
    for u in units:
        ends = [k for k in range(1, len(u) + 1) if k == len(u) or u[k] & 0xC0 != 0x80]
        for a, b in zip([0, *ends], ends):
            found = {(at + a, at + e) for e in ends if e > a and u[a:e] in pieces}
            want |= found | ({(at + a, at + b)} if (at + a, at + b) not in found else set())
        at += len(u)
    assert set(zip(lattice.start.tolist(), lattice.end.tolist())) == want
    assert all((p < 0) == (data[a:b].tobytes() not in pieces) or b - a == 1 for a, b, p in zip(lattice.start, lattice.end, lattice.piece))
    assert sum(asked) < 8 * len(data)


def test_draws_of_a_slice_are_made_together(model, monkeypatch):
    import numpy as np

    from tessera.llm import pieces as X

    voc = X.vocabulary(model, 1.0)
    texts = [b"the thing number %d" % i for i in range(60)] + [b"", b"a"]
    offsets = np.cumsum([0, *map(len, texts)])
    keys = X.W.mix(np.arange(1, len(texts) + 1, dtype=np.uint64))
    data = np.frombuffer(b"".join(texts), np.uint8)
    calls, below = [], X.gumbel_below
    monkeypatch.setattr(X, "gumbel_below", lambda *args: calls.append(args) or below(*args))
    part = X.Slice(data, offsets, keys, voc)
    together = part.sample(3)
    assert len(calls) <= 6  # one for each turn's paths and one for the nodes they leave open
    for i, text in enumerate(texts):
        single = X.Slice(np.frombuffer(text, np.uint8), np.array([0, len(text)]), keys[i: i + 1], voc)
        alone = single.sample(3)[0]
        assert [part.ids(e).tolist() for e, *_ in together[i]] == [single.ids(e).tolist() for e, *_ in alone]
        assert np.allclose([x[1:] for x in together[i]], [x[1:] for x in alone], rtol=1e-9)
