"""Vector cells and blocks of postings against searches of everything; access by prefixes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import acl, cells, ranked, signals


def clusters(n, kinds=40, size=16):
    deal = np.random.default_rng(3)
    centres = deal.normal(size=(kinds, size))
    return [(i, (centres[i % kinds] + 0.25 * deal.normal(size=size)).tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def vectors(spark):
    rows = clusters(3000) + [(5000, None), (5001, [0.0] * 16), (5002, [1.0] * 3), (5003, [float("nan")] * 16)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4)


def test_cells_find_neighbours_and_read_a_part(spark, vectors):
    index = cells.build(vectors, "id")
    row = cells.recall(spark, index, vectors.where("id % 30 = 0"), "id").first()
    assert row.recall >= 0.9 and row.share_read < 0.3 and row.queries == 100
    probe = next(v for i, v in clusters(3000) if i == 17)
    exact = [r.id for r in signals.vector_topk(vectors, probe, "id", 20).collect()]
    assert len(set(exact) & {r.id for r in cells.search(spark, index, probe, "id").collect()}) >= 18
    every = cells.search(spark, cells.Cells(index.path, index.centres, len(index.centres)), probe, "id")
    assert [r.id for r in every.collect()] == exact
    plan = cells.search(spark, index, probe, "id")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:120]


def test_all_cells_give_the_exact_neighbours_of_each_query(spark, vectors):
    index = cells.build(vectors, "id", cells=9)
    got = {}
    for r in cells.search_many(spark, cells.Cells(index.path, index.centres, 9), vectors.where("id % 100 = 0"), "id", 5).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["key"]))
    x = cells.directions([v for _, v in clusters(3000)], 16)
    for q, rows in got.items():
        assert [k for _, k in sorted(rows)] == np.argsort(-(x @ x[q]), kind="stable")[:5].tolist()
    assert len(got) == 30


def test_cells_of_nothing_and_of_copies(spark, vectors):
    none = cells.build(vectors.limit(0), "id")
    assert cells.search_many(spark, none, vectors.limit(3), "id").count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(700)], "id long, embedding array<float>")
    index = cells.build(same, "id")
    found = cells.search_many(spark, index, same.limit(2), "id", 20)
    assert found.count() == 40 and found.where("score < 0.999999").count() == 0


def test_ranked_blocks_give_the_full_ranking(spark, tmp_path):
    deal = random.Random(9)
    texts = [(i, " ".join(deal.choices(["the", "of", "x", "y", "z", "w"], [3, 2, 9, 9, 9, 9], k=deal.choice([3, 8, 30, 200])))) for i in range(1500)] + [(9000, None), (9001, "")]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    ranked.write_index(docs, f"{tmp_path}/i", "id", block=16)
    for query, limit in (("the of", 20), ("the", 7), ("of the of the", 100), ("never", 5), ("the never", 5), ("!", 5)):
        got, read = ranked.top_ranked(spark, f"{tmp_path}/i", query, "id", limit)
        hits = signals.fts_match(signals.postings(docs, "id"), query, "id")
        want = hits.withColumn("score", signals.cover_density("lists")).orderBy(F.desc(F.round("score", 9)), "id").limit(limit).select("id", F.round("score", 9)).collect()
        assert [(r.id, round(r.score, 9)) for r in got.collect()] == [tuple(r) for r in want]
    assert ranked.top_ranked(spark, f"{tmp_path}/i", "the of", "id", 20)[1]["read"] < 0.5 * ranked.top_ranked(spark, f"{tmp_path}/i", "the of", "id", 20)[1]["blocks"]


def test_entries_that_cover_each_other_show_a_row_once(spark):
    paths = [(i, r, p) for i, (r, p) in enumerate([("r", "a/b/c"), ("r", "a"), ("r", "ab"), ("r", ""), ("r", None), ("s", "x"), ("s", None), ("t", "a"), (None, "a")])] * 2
    rows = spark.createDataFrame(paths, "id int, repository_id string, path string")
    entries = [("r", "a"), ("r", "a/b"), ("s", "")]
    seen = lambda **k: sorted(r.id for r in acl.visible(rows, acl.acl_table(spark, entries), **k).collect())
    assert seen() == [0, 0, 1, 1, 5, 5, 6, 6]
    assert seen(optional=True) == [0, 0, 1, 1, 4, 4, 5, 5, 6, 6]
    assert sorted(map(tuple, acl.least_entries(acl.acl_table(spark, entries)).collect())) == [("r", "a"), ("s", "")]
