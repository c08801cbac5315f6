import random

import pytest

CLASHING = ["rid", "size", "score", "host", "votes", "shard", "slot", "th", "taken", "sample", "labels", "ratio", "key", "bucket"]


def _prose(rng, n):
    vocabulary = [f"w{i}" for i in range(400)]
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", ","]) for _ in range(n))


def hard_documents():
    """(doc_id, text, lang, source): nulls, blanks, ties, copies, near copies, a long text and odd characters."""
    rng = random.Random(3)
    base = [_prose(rng, 120) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(base)]
    for i, t in enumerate(base[:4]):
        words = t.split(" ")
        words[7] = "changed"
        rows.append((100 + i, " ".join(words), "en", "s0"))
        rows.append((200 + i, t.upper().lower() + " ", None, None))
    rows += [(5, base[5], "en", "s1"), (5, base[5], "en", "s1"), (None, base[6], "en", "s2"), (None, None, None, None), (None, "", None, "s1")]
    rows += [(300, None, "en", "s3"), (301, "", "en", ""), (302, " \n\t ", "en", "s0"), (303, "one", "en", "s1"), (304, "one two", "en", None),
             (305, "one two", "en", None), (306, "Héllo ▁ 日本 \U0001d518\x00 end\n\n  two  spaces", "xx", "s2"), (307, "same line\nsame line\nsame line", "en", "s3"),
             (308, "All rights reserved. Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", "en", "s0"),
             (309, "a b c a b c a b c x y z", "en", "s0"), (310, " ".join([_prose(rng, 30_000), base[0]]), "en", "s1"), (311, "#&% | *** $$$ <b>", "en", "s2")]
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    from pyspark.sql import functions as F

    rows = [(*r, None if r[1] is None else len(r[1])) for r in hard_documents()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame = frame.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING]).repartition(3, "n_chars")
    return frame.cache()


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.where("doc_id < -1")
