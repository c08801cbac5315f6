"""Near duplicates, sharding, mixing and components against brute force."""

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import CLASHING


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _components(rows, k, share):
    """Component of each row (by number): smallest id reachable, by all pairs."""
    sets = []
    for _, text in rows:
        w = _words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= share * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    return sets, [root(i) for i in range(len(rows))]


@pytest.mark.parametrize("words", [4, 5])
def test_near_duplicates_equal_all_pairs(spark, documents, words):
    from tessera.llm.minhash import near_duplicates

    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    sets, roots = _components(rows, words, 80)
    least = defaultdict(lambda: None)
    for (i, _), s, r in zip(rows, sets, roots, strict=True):
        if s and i is not None and (least[r] is None or i < least[r]):
            least[r] = i
    expected = Counter((i, len(s), least[r] if s else i) for (i, _), s, r in zip(rows, sets, roots, strict=True))
    found = near_duplicates(documents, words=words).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == expected
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in found)
    assert sum(r["stays"] for r in found) == len({r for r, s in zip(roots, sets, strict=True) if s}) + sum(not s for s in sets)


def test_deduplicated_keeps_columns_and_one_row_of_each_group(documents):
    from tessera.llm.minhash import deduplicated, near_duplicates

    left = deduplicated(documents)
    assert left.columns == documents.columns
    assert left.count() == near_duplicates(documents).where("stays").count()
    assert left.where(F.col("doc_id") == 5).count() == 1


def test_near_duplicates_of_nothing(nothing):
    from tessera.llm.minhash import deduplicated, near_duplicates

    assert near_duplicates(nothing).count() == 0
    assert deduplicated(nothing).columns == nothing.columns


def test_a_bucket_with_two_groups_loses_no_link(spark):
    """Texts near 0.8 to a common base, some of which meet only each other."""
    import random

    from tessera.llm.minhash import near_duplicates

    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(60):
        w = list(base)
        for j in rng.sample(range(150), rng.randint(1, 6)):
            w[j] = f"n{rng.randint(0, 30)}"
        rows.append((i, " ".join(w)))
    _, roots = _components(rows, 4, 80)
    least = {r: min(i for i in range(60) if roots[i] == r) for r in roots}
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: least[roots[i]] for i in range(60)}


def test_components_of_a_chain(spark):
    from tessera.llm.components import connected_components

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_shards_have_exact_sizes_and_gapless_slots(documents, nothing):
    from tessera.llm.sharding import shuffled

    out = shuffled(documents.select("doc_id", "text", "shard"), 7).collect()
    assert len(out) == documents.count() and set(out[0].asDict()) == {"doc_id", "text", "shard", "_shard", "_slot"} - {"_slot"} | {"slot"}
    slots = defaultdict(list)
    for r in out:
        slots[r["_shard"]].append(r["slot"])
    assert sorted(slots) == list(range(7))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in documents.select("doc_id").collect())
    assert shuffled(nothing.select("doc_id"), 7).count() == 0


def test_a_joined_matrix_and_small_tasks_deal_the_same(documents, monkeypatch):
    from tessera.llm import sharding

    rows = documents.select("doc_id", "text").coalesce(1).sortWithinPartitions(F.xxhash64("text", "doc_id"))
    whole = Counter(map(tuple, sharding.shuffled(rows, 5).collect()))
    assert Counter(map(tuple, sharding.shuffled(rows, 5, task_bytes=1).collect())) == whole
    monkeypatch.setattr(sharding, "SENT_COUNTS", 0)
    assert Counter(map(tuple, sharding.shuffled(rows, 5).collect())) == whole
    assert sharding.shuffled(rows.where("doc_id < -1"), 5).count() == 0


def test_tasks_hold_about_so_many_bytes(spark):
    from tessera.llm.sharding import shuffled

    rows = spark.range(4000).select("id", F.repeat(F.lit("x"), 100).alias("text"))
    dealt = shuffled(rows, 2, task_bytes=20_000).collect()
    assert len(dealt) == 4000 and {r["shard"] for r in dealt} == {0, 1}
    plan = shuffled(rows, 2, task_bytes=20_000)._jdf.queryExecution().optimizedPlan().toString()
    rows_a_part = int(re.search(r"FLOOR\(\(cast\(slot#\d+L? as double\) / (\d+)\.0\)", plan).group(1))
    assert 120 <= rows_a_part <= 180  # about 120 bytes a row


def test_the_sharding_query_moves_whole_documents(spark, monkeypatch):
    import zlib

    from tessera.llm import queries, sharding

    seen, whole = [], sharding.shuffled
    monkeypatch.setattr(sharding, "shuffled", lambda rows, *a, **b: seen.append(rows.columns) or whole(rows, *a, **b))
    monkeypatch.setattr(queries, "read_table", lambda *_: spark.createDataFrame([(1, "one text"), (2, None)], "doc_id long, text string"))
    rows = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in queries.q_sharding(spark, "").collect()}
    assert seen == [["doc_id", "text"]] and rows == {1: (24, zlib.crc32(b"one text")), 2: (16, 0)}


def test_matrix_sums_and_distribution(spark):
    from tessera.llm.matrix import communication_matrix

    sizes, goals = [50, 10, 0, 30, 7, 3], [40, 30, 20, 10]
    rows = spark.createDataFrame(list(enumerate(sizes)), "id long, n long")
    for seed in range(2):
        found = communication_matrix(rows, F.lit(goals).cast("array<long>"), seed).orderBy("id").collect()
        m = np.array([r["counts"] for r in found])
        assert (m.sum(1) == sizes).all() and (m.sum(0) == goals).all() and (m >= 0).all()
        assert (np.array([r["offsets"] for r in found]) == np.cumsum(m, 0) - m).all()


def test_hypergeometric_draws_follow_the_distribution(spark):
    from math import comb

    from tessera.llm.common import unit
    from tessera.llm.matrix import hypergeometric

    n = 4000
    t, g, d = (F.lit(x).cast("long") for x in (40, 13, 17))
    found = Counter(r[0] for r in spark.range(n).select(hypergeometric(t, g, d, unit(F.col("id")))).collect())
    for k in range(14):
        p = comb(13, k) * comb(27, 17 - k) / comb(40, 17) if 17 - k <= 27 else 0
        assert abs(found[k] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 2 / n


def test_permutation_is_one(spark):
    from tessera.llm.common import permuted

    for n in (1, 2, 7, 1000):
        out = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long"))).collect()]
        assert sorted(out) == list(range(n))
        assert n < 1000 or sum(a == b for a, b in enumerate(out)) < 20


def test_permutation_of_a_column_is_the_same_one(spark):
    from tessera.llm.common import permuted, permuted_column

    rows = spark.range(1, 60).selectExpr("id AS n", "id % 3 AS Partner", "explode(sequence(0L, id - 1)) AS x")
    both = rows.withColumn("seed", F.xxhash64("Partner")).withColumn("want", permuted(F.col("x"), F.col("n"), F.col("seed"), 24))
    found = permuted_column(both, "x", "n", "seed", 24)
    assert sorted(found.columns) == sorted(both.columns)
    assert found.agg(F.sum((F.col("x") == F.col("want")).cast("int"))).first()[0] == rows.count()


def _targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, cap = sum(sizes.values()), {}
    free = set(order)
    while free:
        level = (total - sum(cap.values())) / sum(w[s] for s in free)
        new = [s for s in free if level * w[s] > 3 * sizes[s]]
        if not new:
            return {**cap, **{s: level * w[s] for s in free}}
        for s in new:
            cap[s] = 3 * sizes[s]
            free.discard(s)
    return cap


def test_mix_meets_targets_and_never_overuses(documents, nothing):
    from tessera.llm.mixing import mix, taken

    plan = mix(documents, keep=["doc_id", "source", "text", "size"], block_words=16, shard_slots=64)
    rows = taken(plan).collect()
    sizes, got = Counter(), Counter()
    for r in rows:
        n = len(_words(r["text"]))
        assert r["_size"] == n and 0 <= r["taken"] <= 3 * n
        sizes[r["source"]] += n
        got[r["source"]] += r["taken"]
    expected = _targets(sizes)
    found = {r["source"]: r["target"] for r in plan.sources.collect()}
    assert found.keys() == expected.keys()
    assert all(abs(found[s] - expected[s]) < 1e-6 * max(1, expected[s]) for s in found)
    assert all(abs(got[s] - expected[s]) <= 16 for s in found)
    again = taken(mix(documents.repartition(5), keep=["doc_id", "source", "text"], block_words=16, shard_slots=64)).collect()
    assert Counter((r["doc_id"], r["text"], r["taken"]) for r in again) == Counter((r["doc_id"], r["text"], r["taken"]) for r in rows)
    assert taken(mix(nothing, keep=["doc_id", "source", "text"])).count() == 0


def test_mixed_documents_are_pieces_of_the_texts(documents):
    from tessera.llm.mixing import mixed_documents

    out = mixed_documents(documents, block_words=16)
    assert out.columns == documents.columns
    texts = Counter(r["text"] for r in documents.collect())
    for r in out.select("text", "n_chars", *CLASHING[:2]).collect():
        assert len(r["text"]) == r["n_chars"] and any(t and r["text"] in t for t in texts)


def test_many_candidates_are_joined_with_the_same_result(documents, monkeypatch):
    from tessera.llm import minhash

    sent = Counter(tuple(r) for r in minhash.near_duplicates(documents).collect())
    monkeypatch.setattr(minhash, "SENT_CLASSES", 0)
    assert Counter(tuple(r) for r in minhash.near_duplicates(documents).collect()) == sent


def test_rounds_of_few_links_need_no_shuffle(spark, monkeypatch):
    from tessera.llm import components as X

    plans = []
    stored = X.stored
    monkeypatch.setattr(X, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (7, 7)], "a long, b long")
    few = {tuple(r) for r in X.connected_components(links).collect()}
    assert few == {*((i, 0) for i in range(21)), (100, 100), (101, 100)}
    assert len(plans) > 2 and not any("Exchange hashpartitioning" in p for p in plans[1:])
    monkeypatch.setattr(X, "TASK_PAIRS", 0)
    assert {tuple(r) for r in X.connected_components(links).collect()} == few


def test_band_rows_are_dealt_once(spark, documents, monkeypatch):
    from tessera.llm import minhash

    kept = []
    stored = minhash.stored
    monkeypatch.setattr(minhash, "stored", lambda df: kept.append(df) or stored(df))
    minhash.near_duplicates(documents)
    posts = next(df for df in kept if "hub" in df.columns)
    rows = posts.count()
    dealt = posts.groupBy("bucket").agg(F.min("cid").alias("least"), F.max("cid").alias("most"), F.min("hub").alias("hub"), F.max("hub").alias("last_hub"))
    assert rows and not dealt.where("least <> hub or hub <> last_hub or least = most").count()
    plan = posts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [bucket") == 2  # of one exchange, used twice


def test_components_plan_each_round_s_links_once_for_each_use(spark, monkeypatch):
    """Plans that double with each use fill the driver's memory."""
    import random

    from tessera.llm import components as X

    scans, stored = [], X.stored

    def counted(df):
        scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD"))
        return stored(df)

    monkeypatch.setattr(X, "stored", counted)
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    least = {n: n for a, b in links for n in (a, b) if a != b}
    for _ in range(60):
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    found = X.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r["node"], r["component"]) for r in found) == sorted(least.items())
    assert len(scans) > 2 and max(scans[1:]) <= 4
