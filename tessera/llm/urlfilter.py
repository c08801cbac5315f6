"""URL filter: rules first, then trust and distrust that spread over host links.

Hosts with allowed pages are trusted seeds, hosts with blocked pages are
distrusted ones.  Personalised PageRank carries trust along links; distrust
goes against them, to the hosts that link to what is blocked.  A host is
blocked if its distrust outweighs its trust and its size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import columns, own_name, packed, stored
from tessera.llm.urls import host_of, path_of

#: (host, path, verdict); a rule fits its host and all subdomains, and paths that start with its own.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DAMPING, TOLERANCE = 0.7, 0.01
#: Weight of the tie between a host and the domain above it, where a link counts 1.
PARENT_WEIGHT = 0.5
#: A host is blocked below this balance, (trust - distrust) / (trust + distrust + its
#: share of all pages): a few blocked pages of a large host do not block the host.
LEAST_BALANCE = -0.25
#: Parts that a hub's links, and a large host's pages, are dealt over.
SALTS = 16
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, as text, and its verdict; null without one."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, n): pages of one host that link to another host."""
    links = pages.where(F.col(host) != "").select(F.col(host).alias("src"), F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_LINK), F.lit(1)), lambda x: host_of(F.concat(F.lit("://"), x))))).alias("dst"))
    return links.where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def parent_ties(hosts: DataFrame) -> DataFrame:
    """(src, dst, n) both ways between each host and the domain above it, up to two labels."""
    labels = F.split("host", r"\.")
    ups = hosts.select(F.explode(F.when(F.size(labels) > 2, F.transform(F.sequence(F.lit(0), F.size(labels) - 3), lambda i: F.struct(
        F.array_join(F.slice(labels, i + 1, F.size(labels)), ".").alias("a"), F.array_join(F.slice(labels, i + 2, F.size(labels)), ".").alias("b"))))).alias("t")) \
        .select("t.*").distinct()
    return ups.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(PARENT_WEIGHT).alias("n")).union(
        ups.select(F.col("b"), F.col("a"), F.lit(PARENT_WEIGHT)))


def spread(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """(kind, node, score): PageRank from seeds (kind, node, weight); kind
    "trust" follows links (src, dst, n), kind "distrust" goes against them.

    The series is summed until what is left is under TOLERANCE of the whole.
    A hub's links are dealt over SALTS parts, and scores add up before they
    are shuffled.
    """
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").union(
        links.select(F.lit("distrust"), F.col("dst"), F.col("src"), F.col("n")))
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    salt = F.pmod(F.xxhash64("dst"), F.lit(SALTS))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    edges = edges.withColumn("salt", salt).join(out.withColumn("salt", salts), ["kind", "src", "salt"])
    edges = stored(edges.select("kind", "src", "salt", "dst", (F.col("n") / F.col("total")).alias("share")))
    totals = seeds.groupBy("kind").agg(F.sum("weight").alias("whole"))
    now = stored(seeds.join(F.broadcast(totals), "kind").select("kind", "node", (F.col("weight") / F.col("whole") * (1 - DAMPING)).alias("score")))  # two rows
    sums, steps = now, math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
    for step in range(1, steps + 1):
        moved = now.withColumn("salt", salts).withColumnRenamed("node", "src").join(edges, ["kind", "src", "salt"])
        now = moved.groupBy("kind", F.col("dst").alias("node")).agg((DAMPING * F.sum(F.col("score") * F.col("share"))).alias("score"))
        now = stored(now)  # each step is read twice: by the next one and by the sum
        sums = sums.union(now)
    return sums.groupBy("kind", "node").agg(F.sum("score").alias("score"))


def judged(pages: DataFrame, *, rules=RULES, url_col: str = "url", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the html) of every page with host, path,
    rule, verdict, trust and distrust.

    The longest fitting rule decides; without one the host's balance of trust
    and distrust does, and a host that neither reaches is allowed.  Urls that are
    null or without ``://`` have an empty host and path and fit no rule.  Each
    page counts as a seed by its rule, so a host can be both.  Null html has no
    links; repeated pages count as often as they stand.  New columns take a
    longer name where the pages have theirs.
    """
    keep = [c for c in pages.columns if c != html_col] if keep is None else keep
    name = {n: own_name(pages, n) for n in ("host", "path", "rule", "verdict", "trust", "distrust", "salt")}
    named = pages.withColumn(name["host"], host_of(F.col(url_col))).withColumn(name["path"], path_of(F.col(url_col)))
    rule, verdict = rule_of(F.col(name["host"]), F.col(name["path"]), rules)
    slim = named.select(F.col(name["host"]).alias("host"), verdict.alias("verdict"))
    kinds = F.when(F.col("verdict") == "allow", "trust").when(F.col("verdict") == "block", "distrust")
    hosts = stored(slim.where("host <> ''").groupBy("host", kinds.alias("kind")).agg(F.count("*").cast("double").alias("weight")))
    links = host_links(named.select(F.col(name["host"]).alias("host"), F.col(html_col).alias("html")), "host", "html") \
        .union(parent_ties(hosts.select("host").distinct())).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    scores = spread(links, hosts.where("kind is not null").select("kind", F.col("host").alias("node"), "weight"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    shares = hosts.groupBy(F.col("host").alias("node")).agg(F.sum("weight").alias("n"))
    whole = hosts.agg(F.coalesce(F.sum("weight"), F.lit(1.0))).first()[0]
    per_host = scores.groupBy("node").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])
    per_host = stored(per_host.join(shares, "node").withColumn("share", F.col("n") / whole).drop("n"))
    salt = F.pmod(F.xxhash64(F.col(f"`{url_col}`")), F.lit(SALTS))
    left = packed(named.select(*columns(keep), name["host"], name["path"], rule.alias(name["rule"]), verdict.alias(name["verdict"]), salt.alias(name["salt"])))
    left = left.select("row", F.col(f"row.{name['host']}").alias("node"), F.col(f"row.{name['salt']}").alias("salt"))
    joined = left.join(per_host.withColumn("salt", salts), ["node", "salt"], "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    balance = F.when(trust + distrust > 0, (trust - distrust) / (trust + distrust + F.col("share"))).otherwise(0.0)
    found = F.coalesce(F.col(f"row.{name['verdict']}"), F.when(balance < LEAST_BALANCE, "block").otherwise("allow"))
    return joined.select(*columns((*keep, name["host"], name["path"], name["rule"]), "row"), found.alias(name["verdict"]),
                         trust.alias(name["trust"]), distrust.alias(name["distrust"]))
