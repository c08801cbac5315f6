"""URL filter, HTML extraction and nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

RULES = [("net", "/"), ("example.net", "/en/"), ("example.com", "/de/"), ("org", "/fr/")]
URLS = ["http://a.example.net/en/1?x", "https://A.Example.NET/de/2#y", "http://b.example.com/de/1", "http://b.example.com/en/1", "http://c.example.org/fr/", "http://c.example.org/it",
        "http://net/", "http://net", "no scheme", None, "", "http://", "x://y?z/en", "http://notnet/x", "http://d.example.org", "http://far.test/1", "http://near.test/1"]


@pytest.fixture(scope="session")
def pages(spark):
    html = {15: '<a href="http://b.example.com/x">b</a><a href=//b.example.com>b</a>', 16: "<a HREF='https://c.example.org/q'>", 4: '<a href="http://near.test/2">'}
    rows = [(i, u, html.get(i, f"<html><body><nav>Menu</nav><article><h1>T{i}</h1><p>Text &amp; {i}<p>two</article><footer>f</footer>")) for i, u in enumerate(URLS)]
    rows += [(None, URLS[0], None), (2, URLS[2], rows[2][2]), (2, URLS[2], rows[2][2])]
    return spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit("own").alias(c) for c in ("host", "rule", "salt", "text", "node")]).cache()


def _expected(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def test_rules_and_propagation(pages):
    from tessera.llm.urlfilter import judged

    rows = judged(pages, keep=["page_id", "url", "host"]).collect()
    assert len(rows) == pages.count()
    for r in rows:
        host, path = _expected(r["url"])
        assert (r["_host"], r["path"]) == (host, path)
        fits = [h + p for h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert r["_rule"] == (max(fits, key=len) if fits else None)
        if fits:
            assert r["verdict"] == ("allow" if r["_rule"] in ("example.net/en/", "org/fr/") else "block")
    by = {r["_host"]: r for r in rows}
    assert by["far.test"]["verdict"] == "block" and by["far.test"]["distrust"] > 0  # it links to a blocked host
    assert by["near.test"]["verdict"] == "allow" and by["near.test"]["trust"] > 0  # a trusted host links to it
    assert by[""]["verdict"] == "allow" and by["notnet"]["trust"] == by["notnet"]["distrust"] == 0


def test_spread_is_personalised_pagerank(spark):
    from tessera.llm.urlfilter import DAMPING, spread

    links = [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "a", 2.0), ("d", "c", 1.0)]
    seeds = [("trust", "a", 2.0), ("trust", "b", 1.0), ("distrust", "c", 5.0)]
    found = {(r["kind"], r["node"]): r["score"] for r in spread(spark.createDataFrame(links, "src string, dst string, n double"),
                                                              spark.createDataFrame(seeds, "kind string, node string, weight double")).collect()}
    names = "abcd"
    w = np.zeros((4, 4))
    for s, t, n in links:
        w[names.index(s), names.index(t)] = n
    for kind, m in (("trust", w), ("distrust", w.T)):
        step = m / np.maximum(m.sum(1, keepdims=True), 1e-300)
        seed = np.array([sum(x for k, node, x in seeds if k == kind and node == v) for v in names])
        exact = (1 - DAMPING) * np.linalg.solve(np.eye(4) - DAMPING * step.T, seed / seed.sum())
        assert all(abs(found.get((kind, v), 0) - exact[i]) < 0.01 for i, v in enumerate(names))


def test_extraction(pages):
    from tessera.llm.htmltext import extracted

    rows = {(r["page_id"], r["url"]): r["_text"] for r in extracted(pages, keep=["page_id", "url", "text"]).collect()}
    assert rows[(0, URLS[0])] == "T0\nText & 0\ntwo" and rows[(None, URLS[0])] == ""
    assert extracted(pages).count() == pages.count() and extracted(pages.where("false")).count() == 0


@pytest.mark.parametrize("html, text", [
    ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\nb"), ("<article><p>x</p><script>1</p></script>y</article><p>z", "x\ny"),
    ("<body><div class='ad'>no</div><p>yes <b>and</b> &lt;b&gt;&nbsp;&#233;</p><!-- c --><form>f</form>", "yes and <b> é"),
    ("<article><h1>T</h1><p>a<br>b<ul><li>1<li>2</ul><aside>s</aside><section id=comments><p>r</section>end", "T\na b\n1\n2\nend"),
    ("<article><p>cut off <a href='x", "cut off"), ("<ARTICLE><P>Up</P></ARTICLE>", "Up"), ("<article>1 < 2 & 3</article>", "1 < 2 & 3"),
    ("<header>h</header><main><p>m</main><footer>f</footer>", "m"), ("<article><p title='a>b'>q</p><svg><text>s</text></svg></article>", "q"),
])
def test_main_text(html, text):
    from tessera.llm.htmltext import main_text

    assert main_text(html, set(), set()) == text


def test_templates_take_out_what_all_pages_of_a_host_share(spark):
    from tessera.llm.htmltext import extracted, host_plans, templates
    from tessera.llm.urls import host_of

    rows = [(i, f"http://h.test/{i}", f"<html><body><div><p>Welcome back</p><p>own {i}</p><p>more {i % 3}</p></div></body></html>") for i in range(6)]
    rows += [(10, "http://other.test/", "<html><body><p>Welcome back</p></body></html>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in extracted(frame).collect()}
    assert found[0] == "own 0\nmore 0" and found[5] == "own 5\nmore 2" and found[10] == "Welcome back"
    slim = frame.select(host_of(F.col("url")).alias("host"), F.xxhash64("url").alias("page"), "html")
    plan = host_plans(templates(slim)).collect()
    assert len(plan) == 1 and len(plan[0]["roots"]) == 1 and len(plan[0]["texts"]) == 1


def test_copies_and_passages_shared_by_few_pages_are_no_template(spark):
    from tessera.llm.htmltext import extracted

    shared = "<p>shared <b>by</b> three</p><p>and more</p>"
    rows = [(i, f"http://h.test/{i}", f"<html><body><p>own {i}</p>{shared if i < 3 else ''}</body></html>") for i in range(12)]
    rows += [(20 + i, f"http://h.test/copy{i}", "<html><body><p>a copied page</p><p>under three urls</p></body></html>") for i in range(3)]
    found = {r["page_id"]: r["text"] for r in extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[0] == "own 0\nshared by three\nand more" and found[22] == "a copied page\nunder three urls"


@pytest.mark.parametrize("html, text", [
    ("<body><main><p>m</main><aside><article><p>teaser</article></aside>", "m"),
    ("<body><p>long own text</p><section class='comments'><article><p>reader</article></section>", "long own text"),
])
def test_boilerplate_is_no_main_slot(html, text):
    from tessera.llm.htmltext import events, main_text

    assert main_text(html, set(), set()) == text
    role = next(e.role for what, stack, _ in events(html) if what == "open" for e in stack[-1:] if e.kind == 3)
    assert main_text(html, {role}, set()) == text


@pytest.mark.parametrize("html, text", [
    (f"<body><nav>n</nav><div class='{c}'><article><h1>T</h1><p>long text</p><div class='share'>s</div></article>{after}</div><p>c</p>", "T\nlong text")
    for c in ("content has-sidebar", "no-sidebar", "search-results", "nav-open", "share-layout")
    for after in ("", "<section class='comments'><article><p>reader, longer than all the rest</article></section>")
] + [("<div id='nav-open'><main><p>m</p><aside>a</aside></main></div>", "m"), ("<body><aside><article><p>teaser</article></aside>", "")])
def test_class_words_do_not_condemn_what_holds_the_main_slot(html, text):
    from tessera.llm.htmltext import main_text

    assert main_text(html, set(), set()) == text


@pytest.mark.parametrize("piece", ['<p id="share-of-market">x</p>', '<section class="search-theory">x</section>', '<p class="alert-level">x</p>',
                                   '<div class="social-policy">x</div>', '<div class="related-story">x</div>'])
def test_words_inside_longer_names_do_not_condemn(piece):
    from tessera.llm.htmltext import main_text

    assert main_text(f"<article><p>a</p>{piece}<div class='site-footer'>f</div><div class='ad slot'>s</div></article>", set(), set()) == "a\nx"
    assert main_text(f"<body>{piece}<div id='comments-area'>c</div></body>", set(), set()) == "x"


def _brute(rows, k):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = {}
    for q, x in fine:
        if q % 50 == 0:
            near = sorted((-float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), i) for i, y in fine if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_nearest_neighbours(spark):
    from tessera.llm.partitions import nearest

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 3
    rows = [(i, (centres[i % 20] + rng.normal(size=8)).tolist()) for i in range(1500)]
    same = rows[0][1]
    rows += [(2000 + i, same) for i in range(700)]  # a third of the rows share one vector
    rows += [(3000, None), (3050, []), (3100, [0.0] * 8), (3150, [None, *same[1:]]), (3200, [float("nan"), *same[1:]]), (3250, [1.0, 2.0]), (None, same)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cid", F.lit("own")).repartition(4)
    found = {}
    for r in nearest(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    exact = _brute(rows, 5)
    assert found.keys() == exact.keys() and all(len(v) == 5 for v in found.values())
    for q in found:
        assert all(abs(s - dict(_brute_all(rows, q))[v]) < 1e-9 for v, s in found[q][:1])
    hits = [len({v for v, _ in found[q]} & {v for v, _ in exact[q]}) / 5 for q in exact if q not in (0, *range(2000, 2700))]
    assert np.mean(hits) >= 0.9
    assert [v for v, _ in found[0]] == [2000, 2001, 2002, 2003, 2004] and [v for v, _ in found[2000]] == [0, 2001, 2002, 2003, 2004]


def _brute_all(rows, q):
    vec = {i: np.array(v, float) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None for x in v)}
    return [(i, float(vec[q] @ y / np.sqrt(vec[q] @ vec[q]) / np.sqrt(y @ y))) for i, y in vec.items() if np.isfinite(y).all() and y.any()]


def test_few_and_no_vectors(spark):
    from tessera.llm.partitions import nearest

    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[1:3] for r in nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert nearest(few.where("false"), F.col("vec_id") == 0).count() == 0
    assert nearest(few, F.lit(False)).count() == 0


def test_parts_are_balanced():
    from tessera.llm.partitions import balanced_parts, neighbour_graph

    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sizes = np.bincount(balanced_parts(x, neighbour_graph(x, 8), 7, rng), minlength=7)
    assert sizes.sum() == 600 and sizes.max() <= np.ceil(1.1 * 600 / 7) and sizes.min() > 0


def test_outliers_repeated_rows_and_ids_with_two_vectors(spark):
    """A dense cluster with scattered outliers: every query has its five, and nearly all of them are the nearest."""
    from tessera.llm.partitions import nearest

    rng = np.random.default_rng(6)
    rows = [(i, (np.ones(8) + rng.normal(scale=0.05, size=8)).tolist()) for i in range(3000)]
    rows += [(50 * (100 + i), (rng.normal(size=8) * 3).tolist()) for i in range(12)]
    plain = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()]
    expected = _brute(rows, 5)
    got = {}
    for q, _, i in sorted(plain):
        got.setdefault(q, []).append(i)
    assert all(len(v) == 5 for v in got.values()) and set(got) == set(expected)
    far = [q for q in expected if q >= 5000]
    assert sum(i in got[q] for q in far for i, _ in expected[q]) == 5 * len(far)
    assert sum(i in got[q] for q in got for i, _ in expected[q]) >= 0.9 * 5 * len(got)

    few = [(0, [1.0] * 8)] * 6 + [(1, [1.0] * 8), (2, [2.0] * 8), (3, [1.0] * 7 + [2.0]), (3, [1.0] * 7 + [9.0]), (4, [-1.0] * 8)]
    found = nearest(spark.createDataFrame(few, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert sorted(r["rank"] for r in found) == [1, 2, 3, 4] and sorted(r["vec_id"] for r in found) == [1, 2, 3, 4]
