"""License scans by diagonal voting.

Every rolling run of ``k`` words of every text is hashed; runs that occur in a
license template are joined to their template positions, and each match votes
for the diagonal (text position less template position) on which the template
would lie.  Neighbouring diagonals, where words were put in or left out, are
merged, and a span counts if its matches cover enough of the template's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import wordhash as W
from tessera.llm.common import columns, own_name, packed, plain, stored

# Phrases with their labels, and license notices with theirs.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
            "Software is furnished to do so, subject to the following conditions"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("reserved", "All rights reserved."),
    ("reserved", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
)
WORDS_IN_RUN = 3
#: Diagonals at most so far from the next belong to one span.
DIAGONAL_GAP = 2
#: Share of the template's words that a span must cover.
LEAST_SHARE = 0.8


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return W.word_hashes(raw, np.array([0, len(raw)]), W.ALNUM)[0]


def template_runs(k: int = WORDS_IN_RUN) -> list[tuple[int, int, int, str, int]]:
    """(hash, template, position, label, words of the template) of each run."""
    rows = []
    for t, (label, text) in enumerate(TEMPLATES):
        words = _hashes(text)
        rows += [(int(h), t, p, label, len(words)) for p, h in enumerate(W.grams(words, k).view(np.int64))]
    return rows


def _scan(batches: Iterator[pa.RecordBatch], *, k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns with the text last, to all but that one, the phrases' places and the runs that some template has."""
    phrases = [(label, _hashes(text)) for text, label in PHRASES.items()]
    wanted = np.unique(np.array([r[0] for r in template_runs(k)], np.int64).view(np.uint64))
    for batch in batches:
        n = batch.num_rows
        words, places, hits = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
        labels: list[set] = [set() for _ in range(n)]
        spots, runs = [], []
        for lo, hi, data, offsets in W.slices(batch.column(batch.num_columns - 1)):
            hashes, first = W.word_hashes(data, offsets, W.ALNUM)
            words[lo:hi] = np.diff(first)
            doc = np.repeat(np.arange(hi - lo), np.diff(first))

            def inside(at: np.ndarray, size: int) -> np.ndarray:
                return at[at + size <= first[doc[at] + 1]]

            for label, phrase in phrases:
                if len(hashes) < len(phrase):
                    continue
                at = np.flatnonzero(hashes[: len(hashes) - len(phrase) + 1] == phrase[0])
                for j in range(1, len(phrase)):
                    at = at[hashes[at + j] == phrase[j]]
                at = inside(at, len(phrase))
                own = doc[at] + lo
                np.add.at(places, own, 1)
                np.minimum.at(least, own, at - first[doc[at]])
                np.maximum.at(most, own, at - first[doc[at]])
                for i in np.unique(own):
                    labels[i].add(label)
            grams = W.grams(hashes, k)
            if len(grams):
                near = np.minimum(np.searchsorted(wanted, grams), len(wanted) - 1)
                at = inside(np.flatnonzero(wanted[near] == grams), k)
                np.add.at(hits, doc[at] + lo, 1)
                spots.append(at - first[doc[at]])
                runs.append(grams[at].view(np.int64))
        none = places == 0
        ends = pa.array(np.concatenate([[0], np.cumsum(hits)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64))) for x in (spots, runs)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(words), pa.array(places), pa.array(least, mask=none), pa.array(most, mask=none),
             pa.array([sorted(x) for x in labels], pa.list_(pa.string())), *lists], names=names)


def scanned(docs: DataFrame, *, keep: list[str], text_col: str = "text", k: int = WORDS_IN_RUN) -> tuple[DataFrame, str]:
    """Stored ``keep`` columns with rid, n_words, n_base, first_word, last_word,
    base_labels, spots and runs; and the name of the row number column."""
    rid, text = own_name(docs, "rid"), own_name(docs, "scanned_text")
    rows = docs.select(*columns(keep), F.monotonically_increasing_id().alias(rid), F.coalesce(F.col(text_col), F.lit("")).alias(text))
    kinds = (("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()),
             ("base_labels", T.ArrayType(T.StringType())), ("spots", T.ArrayType(T.LongType())), ("runs", T.ArrayType(T.LongType())))
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(own_name(docs, n), t) for n, t in kinds]])
    return stored(plain(rows).mapInArrow(partial(_scan, k=k, names=schema.names), schema)), rid


def license_spans(scan: DataFrame, rid: str, spots: str = "spots", runs: str = "runs", *, k: int = WORDS_IN_RUN) -> DataFrame:
    """(rid, label, template, start, end, share) of the spans that hold a template.

    Matches of a text vote in its own group only, and their number is bounded
    by the text's length, so a passage that many texts share meets nowhere.
    """
    spark: SparkSession = scan.sparkSession
    known = F.broadcast(spark.createDataFrame(template_runs(k), "run long, template int, at int, label string, size int"))  # a fixed table
    hits = scan.where(F.size(spots) > 0).select(F.col(rid).alias("rid"), F.explode(F.arrays_zip(F.col(spots).alias("spot"), F.col(runs).alias("run"))).alias("h")) \
        .select("rid", F.col("h.spot").alias("spot"), F.col("h.run").alias("run"))
    votes = hits.join(known, "run").withColumn("diagonal", F.col("spot") - F.col("at"))
    lines = votes.groupBy("rid", "template", "label", "size", "diagonal").agg(
        F.collect_set("at").alias("at"), F.min("spot").alias("start"), F.max("spot").alias("last"))
    order = Window.partitionBy("rid", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal", 1).over(order) > DIAGONAL_GAP).cast("int")
    lines = lines.withColumn("span", F.sum(F.coalesce(apart, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = lines.groupBy("rid", "template", "label", "size", "span").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"), F.min("start").alias("start"), (F.max("last") + k).alias("end"))
    covered = F.aggregate("at", F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n")), lambda s, p: F.struct(
        p.alias("last"), (s["n"] + F.least(F.lit(k), p - s["last"])).alias("n")), lambda s: s["n"])
    return spans.withColumn("share", covered / F.col("size")).where(F.col("share") >= LEAST_SHARE) \
        .select("rid", "label", "template", "start", "end", "share")


def licenses(docs: DataFrame, *, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``keep`` columns (default: all but the text) of every row with n_words,
    n_base, first_word, last_word, base_labels, labels and score.

    Words are runs of letters, digits and non-ASCII characters, A-Z as a-z.  The
    base counts every place of the fixed phrases; labels adds those of the
    spans found by voting.  score is the largest share of a template that the
    text holds, 1 where a fixed phrase stands, 0 with neither.  Null and blank
    texts have no words, no places (null) and empty labels.  Rows are told apart
    by number, so null and repeated ids do no harm.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    scan, rid = scanned(docs, keep=keep, text_col=text_col)
    name = {n: own_name(docs, n) for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "spots", "runs")}
    spans = license_spans(scan, rid, name["spots"], name["runs"]).groupBy("rid").agg(
        F.collect_set("label").alias("found"), F.max("share").alias("share"))
    out = packed(scan, rid=F.col(rid)).join(spans, "rid", "left")
    base, none = F.col(f"row.{name['base_labels']}"), F.array().cast("array<string>")
    every = F.array_sort(F.array_distinct(F.concat(base, F.coalesce("found", none))))
    return out.select(*columns((*keep, *[name[n] for n in ("n_words", "n_base", "first_word", "last_word")]), "row"),
                      F.array_join(base, ",").alias(name["base_labels"]), F.array_join(every, ",").alias(own_name(docs, "labels")),
                      F.when(F.col(f"row.{name['n_base']}") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias(own_name(docs, "score")))
