"""Packing against a greedy pass over all ranked rows."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import fusion
from lodestone.plans import catalog


def greedy(rows, budget, limit=20):
    """(query, chunk, place) from (query, chunk, rank, bytes)."""
    out = set()
    for q in {r[0] for r in rows}:
        left, n = budget, 0
        for _, chunk, _, size in sorted((r for r in rows if r[0] == q), key=lambda r: r[2]):
            if size <= left and n < limit:
                left, n = left - size, n + 1
                out.add((q, chunk, n))
    return out


@pytest.mark.parametrize("at", ["sf0.001", "sf0.01"])
def test_query_takes_all_that_fits(spark, sf, at):
    sf = sf.replace("sf0.001", at)
    size = {str(r.doc_id): r.n for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.octet_length("text").alias("n")).collect()}
    ranked = fusion.rrf(catalog._signals(spark, sf), by=["query"]).select("query", "chunk_key", "rank").collect()
    want = greedy([(r.query, r.chunk_key, r["rank"], size[r.chunk_key]) for r in ranked], 1 << 16)
    assert {(r.query, r.chunk_key, r["rank"]) for r in catalog.QUERIES["budget_packing"](spark, sf).collect()} == want


def test_rounds_equal_one_pass(spark):
    rng = random.Random(1)
    rows = [(q, f"c{i}", i, max(0, 1500 - i + rng.randint(-40, 40)) if q else rng.randint(0, 700)) for q in (None, "a", "") for i in range(1, 1601)]
    sized = spark.createDataFrame(rows, "q string, chunk_key string, rank int, utf8_bytes long")
    got = fusion.packed(sized, 2048, by=["q"], at_once=7).collect()
    assert {(r.q, r.chunk_key, r["rank"]) for r in got} == greedy(rows, 2048) and len(got) == len(greedy(rows, 2048))
