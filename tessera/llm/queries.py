"""Registered queries of this folder: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import read_table


def q_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.urlfilter import judged

    return judged(read_table(spark, sf_dir, "pages"), keep=["page_id"])


def q_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.minhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), words=4).select("doc_id", "n_shingles", "component_id", "kept")


def q_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.sharding import shuffled

    # whole documents are sharded; the digest is of what arrived
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size")
    text_crc32 = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return shuffled(read_table(spark, sf_dir, "documents"), 40).select(
        "doc_id", size, text_crc32, F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def q_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality import quality

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, keep=["doc_id"])


def q_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix, taken

    plan = mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    sources = plan.sources.select(F.col("source").alias("s"), F.col("total").alias("source_size"), "target")
    return taken(plan, keep=["doc_id", "source", plan.size]).join(sources, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", "taken")


def q_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import toxicity, training_fold

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, read_table(spark, sf_dir, "labels"), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(~training_fold(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


def piece_model() -> str:
    """Place of the public piece model (installed with the Python environment, on executors too)."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def q_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pieces import encoded

    return encoded(read_table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model(), keep=["doc_id"])


def q_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.htmltext import extracted

    found = extracted(read_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


def q_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import licenses

    return licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def q_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.partitions import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def q_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.merkle import manifest

    # every second document, by its hash, is tampered with: its line ends go
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return manifest(read_table(spark, sf_dir, "documents"), altered={"text": text})


def q_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.windows import without_copied

    return without_copied(read_table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def q_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.spelling import spelling_variants

    return spelling_variants(read_table(spark, sf_dir, "documents"), dropped=97).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_url_filter": q_urls,
    "op2_sharding": q_sharding,
    "op3_minhash_near_dedup": q_minhash,
    "op4_quality_rules": q_quality,
    "op6_mixing": q_mixing,
    "op5_learned_partitions": q_nearest,
    "op7_toxicity": q_toxicity,
    "op8_license_scan": q_licenses,
    "op9_sentencepiece": q_pieces,
    "op10_html_extraction": q_html,
    "op11_spelling_variants": q_spelling,
    "op12_merkle_manifest": q_merkle,
    "op13_substring_dedup": q_windows,
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""

#: Bits of a text's bytes, lowest first, and the crc32 that they give.
_BITS = "list_transform(range(8 * strlen({0})), lambda i: (('0x' || substr(hex(encode({0})), 2 * (i // 8)::INT + 1, 2))::BIGINT >> (i % 8)) & 1)"
_CRC32 = "xor(list_reduce(" + _BITS + ", lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT), 4294967295)"


def _leaf(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f})::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"


def _tree(name: str, start: str) -> str:
    """Every level of ternary trees (tree, level, pos, d), then each node's siblings before and after it."""
    return f"""
        {name} AS (
            SELECT tree, 0 AS level, pos, d FROM {start}
            UNION ALL
            SELECT tree, level + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos))
            FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}) WHERE n > 1 GROUP BY tree, level, pos // 3),
        {name}_peak AS (SELECT tree, max(level) AS height, max_by(d, level) AS d FROM {name} GROUP BY tree),
        {name}_runs AS (
            SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
                   coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
            FROM {name} a JOIN {name}_peak p ON p.tree = a.tree AND a.level < p.height
            JOIN {name} b ON b.tree = a.tree AND b.level = a.level AND b.pos // 3 = a.pos // 3 GROUP BY 1, 2, 3)"""


def _walk(name: str, tree: str, start: str) -> str:
    """(rid, folded, proof) at the end of the way up."""
    return f"""
        {name} AS (
            SELECT rid, tree, 0 AS level, pos, folded, proof FROM {start}
            UNION ALL
            SELECT rid, w.tree, w.level + 1, w.pos // 3, sha256(before || folded || after), proof || before || after
            FROM {name} w JOIN {tree}_runs r ON r.tree = w.tree AND r.level = w.level AND r.pos = w.pos),
        {name}_end AS (SELECT w.* FROM {name} w JOIN {tree}_peak p ON p.tree = w.tree AND w.level = p.height)"""


ORACLES: dict[str, str] = {
    "op11_spelling_variants": f"""
        WITH RECURSIVE found AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run
            FROM documents),
        counted AS (SELECT doc_id, run, count(*) AS k, doc_id::VARCHAR || ':' || run AS s FROM found GROUP BY doc_id, run),
        hashed AS (SELECT run, k, {_CRC32.format("s")} AS h FROM counted),
        words AS (
            SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(k)::BIGINT AS n
            FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(k) >= 3),
        cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
        near AS (
            SELECT a.word AS a, b.word AS b, b.n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
        best AS (SELECT a, count(*) AS n_near, min({{'less': -n, 'word': b}}) AS m FROM near GROUP BY a),
        formed AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -m.less >= 2 * n THEN m.word END AS form, CASE WHEN -m.less >= 2 * n THEN -m.less END AS form_n
            FROM words LEFT JOIN best ON a = word),
        way AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT w.word, f.word, f.form FROM way w JOIN formed f ON f.word = w.next)
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN way USING (word) WHERE next IS NULL""",
    "op13_substring_dedup": r"""
        WITH worded AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS w FROM worded, unnest(range(1, greatest(len(ws) - 11, 1))) AS t(i)),
        least AS (SELECT w, min(doc_id) AS d FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
        gone AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN least USING (w), range(13) AS t(k) WHERE doc_id > d),
        words AS (SELECT doc_id, p, ws[p] AS word FROM worded, unnest(range(1, len(ws) + 1)) AS t(p)),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM worded LEFT JOIN kept USING (doc_id)""",
    "op12_merkle_manifest": f"""
        WITH RECURSIVE given AS (
            SELECT row_number() OVER () AS rid, doc_id, coalesce('1' || source, '0') AS tree, {_leaf("text")} AS d,
                   CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS folded
            FROM documents),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos, '' AS proof FROM given),
        {_tree("own", "leaves")},
        sources AS (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS pos, d FROM own_peak),
        {_tree("top", "sources")},
        {_walk("inner_way", "own", "leaves")},
        risen AS (SELECT w.rid, '' AS tree, s.pos, w.folded, w.proof FROM inner_way_end w JOIN sources s ON s.name = w.tree),
        {_walk("outer_way", "top", "risen")}
        SELECT doc_id, l.d AS leaf, s.d AS subroot, p.d AS root, sha256(w.proof) AS proof_sha256, w.folded AS folded_root, w.folded = p.d AS verified
        FROM leaves l JOIN outer_way_end w USING (rid) JOIN sources s ON s.name = l.tree, top_peak p""",
    "op3_minhash_near_dedup": f"""
        WITH RECURSIVE worded AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 4 THEN array_to_string(ws[i:i + 3], ' ') ELSE array_to_string(ws, ' ') END AS sh
            FROM worded, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS t(i) WHERE len(ws) > 0),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
            FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * k >= 80 * (x.n + y.n - k)),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (
            SELECT doc_id AS d, doc_id AS m FROM documents
            UNION SELECT e.b, r.m FROM reach r JOIN both_ways e ON e.a = r.d),
        component AS (SELECT d, min(m) AS component_id FROM reach GROUP BY d)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
        FROM documents JOIN component ON d = doc_id LEFT JOIN sizes USING (doc_id)""",
}
