"""Main text of web pages by templates deduced from pages of the same host.

Tokens (element roles and text pieces) that occur equally often on every page
of a host form an equivalence class: they come from the same part of the
template.  Classes that keep one order on all pages are valid; nested by their
role paths they make up the host's template.  What fills its main slot is the
text; template text outside an article is not.

Occurrence vectors are compared by hashes that add up over pages, so the pages
of a host, however many, meet as one row per token and task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import columns, own_name, plain, stored
from tessera.llm.urls import host_of

#: A class must be seen on so many pages of a host, and hold so many tokens.
LEAST_PAGES, LEAST_TOKENS = 3, 2
#: Text is template text only if its class covers this share of the host's distinct pages.
LEAST_SHARE = 0.5
#: Template rows that are sent to every task; more are joined by host.
SENT_ROWS = 500_000

# Element names and the words of classes, ids and roles that tell boilerplate.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
            "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead "
            "tr ul".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = set("ul ol dl table article section main body div nav aside footer header form blockquote td th li".split())
BOILERPLATE_TAGS = set("nav footer aside form script style noscript template iframe svg button select textarea title head dialog menu canvas object".split())
BOILERPLATE_WORDS = set("ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promotion nav navbar "
                        "navigation menu menus breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice notices gdpr "
                        "popup modal newsletter subscribe signup comment comments commentlist respond disqus share sharing social related "
                        "recommended pagination pager contentinfo complementary search alert".split())
HEADER_WORDS = {"header", "topbar"}
LAYOUT_WORDS = set("site main page top bottom left right primary secondary global box bar slot area wrapper wrap container content body inner outer list "
                   "link links widget block panel section unit item items button buttons icon icons".split())
#: Copied pages (host and html) that are sent to every task; more are joined by their hashes.
SENT_COPIES = 500_000

_TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|!--?>|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z))""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


class Element:
    """``wraps``: elements on its path that class words condemn; ``tagged``: boilerplate
    by element names alone; ``within``: boilerplate even if class words do not
    condemn what holds its outermost article or main part."""

    __slots__ = ("boilerplate", "kind", "name", "role", "tagged", "within", "wraps")

    def __init__(self, name: str, role: int, boilerplate: bool, kind: int, wraps: int, tagged: bool, within: bool):
        self.name, self.role, self.boilerplate, self.kind = name, role, boilerplate, kind
        self.wraps, self.tagged, self.within = wraps, tagged, within


@lru_cache(maxsize=65536)
def says(names: str) -> tuple[bool, bool]:
    """Whether some class, id or role among ``names`` tells boilerplate, and whether one tells a header: all
    words of such a name do, or tell a place on the page, so that ``share-of-market`` and ``related-story`` do not."""
    told = [False, False]
    for name in names.split():
        parts = set(_WORD.findall(name))
        for k, known in enumerate((BOILERPLATE_WORDS, HEADER_WORDS)):
            told[k] = told[k] or (bool(parts & known) and parts <= known | LAYOUT_WORDS)
    return told[0], told[1]


def opened(name: str, attributes: str, above: list[Element], in_article: bool) -> Element:
    """An element under ``above``; its role is told by the names on its path."""
    names = " ".join(sorted((b or c or d).lower() for _, b, c, d in _NAMES.findall(attributes))) if attributes else ""
    condemned, heads = says(names) if names else (False, False)
    boilerplate = name in BOILERPLATE_TAGS or condemned or (not in_article and (name == "header" or heads))
    if name in ("html", "body", "article", "main"):
        boilerplate = False
    kind = {"article": 3, "main": 2, "body": 1}.get(name, 0)
    parent = above[-1].role if above else 0
    role = xxhash.xxh64_intdigest(f"{name}\x00{names}", seed=parent)
    top = above[-1] if above else Element("", 0, False, 0, 0, False, False)
    tag = boilerplate and (name in BOILERPLATE_TAGS or name == "header")
    outermost = kind >= 2 and not any(e.kind >= 2 for e in above)
    return Element(name, role, boilerplate or top.boilerplate, kind, top.wraps + (boilerplate and not tag), top.tagged or tag,
                   top.tagged if outermost else boilerplate or top.within)


def events(html: str) -> Iterator[tuple[str, object]]:
    """("open", stack), ("text", stack, raw text) and ("break",) in page order; tolerant of what is left open."""
    stack: list[Element] = []
    at = 0
    article = 0
    while True:
        tag = _TAG.search(html, at)
        text = html[at: tag.start()] if tag else html[at:]
        if text:
            yield "text", stack, text
        if not tag:
            return
        at = tag.end()
        closing, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    article -= sum(e.kind == 3 for e in stack[k:])
                    del stack[k:]
                    break
                if stack[k].name in HOLDS and name not in BLOCK:
                    break  # an inline end tag does not end blocks
            if name in BLOCK:
                yield "break", stack, ""
            continue
        if name in BLOCK:
            ended = ENDED_BY.get(name, {"p"})
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name in ended or stack[k].name == "p":
                    del stack[k:]
                    break
                if stack[k].name in HOLDS:
                    break
            yield "break", stack, ""
        if name == "br":
            yield "text", stack, " "
            continue
        element = opened(name, attributes, stack, article > 0)
        if name in VOID:
            yield "open", [*stack, element], ""
            continue
        stack.append(element)
        article += element.kind == 3
        yield "open", stack, ""
        if attributes and attributes.rstrip().endswith("/") and name not in BLOCK and name not in RAW:
            stack.pop()
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*+(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            stack.pop()


def text_token(role: int, text: str) -> int:
    return xxhash.xxh64_intdigest(" ".join(unescape(text).split()), seed=role ^ 0x5DEECE66D)


def page_tokens(html: str) -> dict[int, list[int]]:
    """Times, first place and kind (4: text, else the element's) of each token of a page."""
    found: dict[int, list[int]] = {}
    for place, (what, stack, text) in enumerate(events(html)):
        if what == "open":
            token, kind = stack[-1].role, 0 if stack[-1].boilerplate else stack[-1].kind
        elif what == "text" and stack and not stack[-1].boilerplate and not any(e.kind == 3 for e in stack) and text.strip():
            token, kind = text_token(stack[-1].role, text), 4
        else:
            continue
        found.setdefault(token, [0, place, kind])[0] += 1
    return found


def lines_of(blocks: list[list[str]]) -> str:
    lines = (" ".join(unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def wrapped_text(html: str) -> str:
    """Text of the articles, or else main parts, under the fewest elements that class words condemn."""
    slots = {(e.wraps, -e.kind) for what, stack, _ in events(html) if what == "open" for e in stack[-1:] if e.kind >= 2 and not e.within}
    slot = min(slots, default=None)
    blocks: list[list[str]] = [[]]
    for what, stack, text in events(html):
        if what == "break":
            blocks.append([])
        elif what == "text" and stack and not stack[-1].within and any((e.wraps, -e.kind) == slot for e in stack):
            blocks[-1].append(text)
    return lines_of(blocks)


def main_text(html: str, roots: set[int], known: set[int]) -> str:
    """Blocks of the elements whose roles are in ``roots`` (or else of the
    page's articles, main parts or body), without boilerplate and, outside
    articles, without text pieces in ``known``; joined by line ends."""
    kinds = set()
    if not roots:
        kinds = {e.kind for what, stack, _ in events(html) if what == "open" for e in stack[-1:] if not e.boilerplate}
    least = 3 if 3 in kinds else 2 if 2 in kinds else 1 if 1 in kinds else 0
    blocks, now, used, held, wrapped = [], [], False, False, False
    for what, stack, text in events(html):
        if what == "open" and stack[-1].kind >= 2:
            held, wrapped = held or not stack[-1].boilerplate, wrapped or (stack[-1].boilerplate and not stack[-1].within)
        if what == "text":
            inside = any(e.role in roots for e in stack) if roots else least == 0 or any(e.kind == least for e in stack)
            if inside and not (stack and stack[-1].boilerplate):
                if known and stack and not any(e.kind == 3 for e in stack) and text_token(stack[-1].role, text) in known:
                    continue
                now.append(text)
                used = used or bool(text.strip())
        elif what == "break" and now:
            blocks.append(now)
            now = []
    if now:
        blocks.append(now)
    if roots and not used:
        return main_text(html, set(), known)  # a page of another kind
    found = lines_of(blocks)
    # class words condemn no wrapper of the main slot: with every article and main part under one, the longer text is it
    return max(found, wrapped_text(html), key=len) if wrapped and not held else found


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, html) to one row per page and token."""
    for batch in batches:
        pages, rows = [], []
        for i, html in enumerate(batch.column(2)):
            for token, (times, place, kind) in page_tokens(html.as_py()).items():
                pages.append(i)
                rows.append((token, times, place, kind))
        at = pa.array(np.array(pages, np.int64))
        token, times, place, kind = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.array(token, np.uint64).view(np.int64)),
             pa.array(np.array(times, np.int32)), pa.array(np.array(place, np.int32)), pa.array(np.array(kind, np.int32))],
            names=["host", "page", "token", "times", "place", "kind"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, token, kind, class, pages, host_pages) of the valid classes' tokens.

    ``pages`` has host, page (a hash of the html, so that copies under other
    urls are one page) and html.
    """
    # only pages that have copies are shuffled with their html
    held = pages.select("host", "page").groupBy("host", "page").agg(F.count("*").alias("copies"))
    hosts = stored(held.groupBy("host").agg(F.count("*").alias("host_pages")))
    copied = stored(held.where("copies > 1").select(F.col("host").alias("h"), F.col("page").alias("p")))
    copied = F.broadcast(copied) if copied.count() <= SENT_COPIES else copied
    same_page = (F.col("host") == F.col("h")) & (F.col("page") == F.col("p"))
    pages = pages.join(copied, same_page, "left_anti").union(pages.join(copied, same_page, "left_semi").dropDuplicates(["host", "page"]))
    tokens = pages.mapInArrow(_tokens, "host string, page long, token long, times int, place int, kind int")
    spot = F.xxhash64("page", "times")
    vectors = tokens.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.bit_xor(spot).alias("v"), F.sum(spot.bitwiseAND((1 << 26) - 1)).alias("w"), F.max("kind").alias("kind"))
    same = stored(vectors.where(F.col("pages") >= LEAST_PAGES).withColumn("class", F.xxhash64("host", "v", "w", "pages")))
    large = same.groupBy("host", "class").agg(F.count("*").alias("size")).where(F.col("size") >= LEAST_TOKENS)
    members = stored(same.join(large, ["host", "class"]).select("host", "token", "kind", "class", "pages"))
    sent = F.broadcast(members) if members.count() <= SENT_ROWS else members
    # a class is valid if its tokens come in one order on all pages
    orders = tokens.join(sent.select("host", "token", "class"), ["host", "token"]).groupBy("host", "class", "page").agg(
        F.xxhash64(F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda x: x["token"])).alias("order"))
    valid = orders.groupBy("host", "class").agg(F.min("order").alias("a"), F.max("order").alias("b")).where("a = b").select("host", "class")
    return members.join(valid, ["host", "class"]).join(hosts, "host")


def host_plans(template: DataFrame) -> DataFrame:
    """(host, roots, texts): roles of the template's main slot, and its text pieces."""
    best = template.where("kind in (1, 2, 3)").groupBy("host").agg(F.max("kind").alias("best"))
    rows = template.join(best, "host", "left")
    return rows.groupBy("host").agg(
        F.sort_array(F.collect_set(F.when(F.col("kind") == F.col("best"), F.col("token")))).alias("roots"),
        F.sort_array(F.collect_set(F.when((F.col("kind") == 4) & (F.col("pages") >= LEAST_SHARE * F.col("host_pages")), F.col("token")))).alias("texts"))


def _extract(batches: Iterator[pa.RecordBatch], *, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns with (roots, texts, html) last, to all but these and the text."""
    for batch in batches:
        n = batch.num_columns
        out = []
        for roots, texts, html in zip(batch.column(n - 3), batch.column(n - 2), batch.column(n - 1), strict=True):
            roots, texts = ({x & 0xFFFFFFFFFFFFFFFF for x in (v.as_py() or ())} for v in (roots, texts))
            out.append(main_text(html.as_py(), roots, texts))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(out, pa.string())], names=names)


def extracted(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` columns (default: all but the html) of every page, with its main text.

    The main slot is the host template's article, else its main part, else its
    body; a page without that slot, or of a host with too few pages for a
    template, uses its own article, main part or body.  Menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles and comments are left
    out, as is text outside articles that fills a class on at least half of the
    host's distinct pages.  Character references are
    decoded, white space within a block becomes one space, blocks are joined by
    line ends.  Null html is an empty page and gives an empty text; null urls
    and urls without a host form one host; equal pages count as one, whatever their urls; a page
    cut off in the middle keeps what it has.  Nothing inside an article is
    dropped for being on many pages.
    """
    keep = [c for c in pages.columns if c != html_col] if keep is None else keep
    host, html = own_name(pages, "host"), own_name(pages, "page_html")
    body = F.coalesce(F.col(html_col), F.lit(""))
    slim = pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(body).alias("page"), body.alias("html"))
    plans = stored(host_plans(templates(slim)))
    size = plans.agg(F.coalesce(F.sum(F.size("roots") + F.size("texts") + 1), F.lit(0))).first()[0]
    plans = plans.select(F.col("host").alias("plan_of_host"), F.col("roots").alias("plan_roots"), F.col("texts").alias("plan_texts"))
    names = {c: own_name(pages, c) for c in plans.columns}
    plans = plans.select(*[F.col(c).alias(n) for c, n in names.items()])
    rows = pages.select(*columns(keep), host_of(F.col(url_col)).alias(host), body.alias(html))
    joined = rows.join(F.broadcast(plans) if size <= SENT_ROWS else plans, F.col(host) == F.col(names["plan_of_host"]), "left")
    joined = joined.select(*columns(keep), names["plan_roots"], names["plan_texts"], html)
    schema = T.StructType([*pages.select(*columns(keep)).schema.fields, T.StructField(own_name(pages.select(*columns(keep)), text_col), T.StringType())])
    return plain(joined).mapInArrow(partial(_extract, names=schema.names), schema)
