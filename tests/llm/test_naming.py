"""Exact dedup by block naming against a dictionary of texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import naming

DOCS = "doc_id long, text string"
BIG = 9_007_199_254_740_993


def want(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        body = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(body, []).append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for body, group in groups.items():
        first = min(group)
        for _, none, doc, i in group:
            out.append((None if none else doc, None if first[1] else first[2], len(group), hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, rows, **sizes):
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("key", "row", "block", "name", "level", "points")}).repartition(4)
    got = naming.exact_duplicates(df, **sizes).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


@pytest.mark.parametrize("sizes", [{}, {"block": 3, "chunk": 7}, {"block": 1, "chunk": 1}])
def test_odd_texts(spark, sizes):
    deal = random.Random(7)
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, None), (None, "ab c"), (4, "a bc"), (4, "a bc"), (BIG, "abc"), (5, "abcd"), (6, "abc\x00"), (7, " abc"), (8, "\U0001f600é"), (9, "\U0001f600 é"), (10, "x" * 20_000), (11, "x" * 20_000 + " "), (12, "x" * 19_999)]
    rows += [(100 + i, "".join(deal.choices("ab \n", k=deal.randint(0, 12)))) for i in range(150)]
    rows += [(300 + i, "same passage " * 5) for i in range(40)] + [(400, "aaabbb"), (401, "bbbaaa"), (402, "aaa bbb bbb"), (403, "aaabbbaaa")]
    check(spark, rows, **sizes)


def test_one_name_for_each_text_and_no_other(spark):
    """Names come from comparing, so texts whose blocks are all shared but stand otherwise differ."""
    blocks = ["aaaa", "bbbb", "cccc"]
    rows = [(i, "".join(blocks[(i // 3**k) % 3] for k in range(5))[: 20 - i % 2]) for i in range(243)] * 2
    ids = naming.identities(spark.createDataFrame(rows, DOCS).repartition(3), block=4).groupBy("level", "name").agg(F.countDistinct("sha").alias("n"), F.count(F.lit(1)).alias("m"))
    assert ids.count() == len({t for _, t in rows}) and ids.where("n > 1").isEmpty()


def test_empty_table(spark):
    assert naming.exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0
