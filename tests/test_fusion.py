"""Rank fusion, diversity, reranking and packing on literals."""

import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators import fusion
from lodestone.validate import ValidationError

ROWS = [("exact", "a", "f1", 1.0, "s1"), ("fts", "a", "f1", 0.4, "s1"), ("fts", "b", "f2", 0.9, "s2"), ("fts", "b", "f2", 0.2, "s2"), ("vector", "c", "f3", 0.8, None), ("vector", "b", "f2", 0.8, "s2")]


@pytest.fixture(scope="module")
def candidates(spark):
    return spark.createDataFrame(ROWS, schemas.CANDIDATE)


def by_rank(df):
    return [r.chunk_key for r in sorted(df.collect(), key=lambda r: r["rank"])]


def test_weights_ranks_and_evidence(candidates):
    rows = {r.chunk_key: r for r in fusion.rrf(candidates).collect()}
    assert rows["a"].fusion_score == 1.0 / 61 + 0.8 / 62 and rows["a"].top_exact
    assert rows["b"].fusion_score == 0.8 / 61 + 0.7 / 61  # its best score counts once; the tie with c goes to b
    assert rows["c"].fusion_score == 0.7 / 62
    assert [e.source for e in rows["b"].evidence] == ["fts", "vector"]


def test_order_of_input_does_not_matter(candidates):
    assert by_rank(fusion.rrf(candidates.orderBy(F.desc("score")))) == by_rank(fusion.rrf(candidates.orderBy("chunk_key"))) == ["a", "b", "c"]


def test_exact_match_leads_only_if_asked(candidates):
    light = {"exact": 0.1, "fts": 0.8, "vector": 0.7}
    assert by_rank(fusion.rrf(candidates, light)) == ["a", "b", "c"]
    assert by_rank(fusion.rrf(candidates, light, pin_exact=False)) == ["b", "a", "c"]


def test_more_candidates_than_a_query_may_have_raise(candidates):
    assert fusion.rrf(candidates, most=3).count() == 3
    with pytest.raises(ValidationError, match="more than 2"):
        fusion.rrf(candidates, most=2)


def test_sources_without_weight_are_dropped(candidates):
    assert by_rank(fusion.rrf(candidates, {"vector": 1.0})) == ["b", "c"]


def test_conflicting_identities_raise(spark, candidates):
    other = spark.createDataFrame([("graph", "a", "f9", 0.5, "s1")], schemas.CANDIDATE)
    with pytest.raises(ValidationError):
        fusion.rrf(candidates.unionByName(other))


def test_a_skipped_row_uses_no_room(spark):
    ranked = spark.createDataFrame([("a", "s1", "f1", 1), ("b", "s1", "f2", 2), ("e", "s2", "f2", 3), ("g", None, "f3", 4), ("h", None, "f4", 5)], "chunk_key string, symbol_key string, file_key string, rank int")
    assert by_rank(fusion.diversify(ranked, 1, 1, 10)) == ["a", "e", "g", "h"]
    assert by_rank(fusion.diversify(ranked, 1, 1, 2)) == ["a", "e"]


def test_reranking(spark, candidates):
    ranked = fusion.rrf(candidates, pin_exact=False)
    scores = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.9)], "chunk_key string, score double")
    rows = {r.chunk_key: r for r in fusion.rerank(ranked, scores, pin_exact=False).collect()}
    assert rows["c"].rerank_rank == 1 and rows["c"].rerank_fusion_score == pytest.approx(0.3 / 3 + 0.7)
    assert [k for k, _ in sorted(rows.items(), key=lambda x: x[1]["rank"])][0] == "c"
    with pytest.raises(ValidationError):
        fusion.rerank(ranked, scores.where("chunk_key <> 'a'"))
    with pytest.raises(ValidationError):
        fusion.rerank(ranked, scores.withColumn("score", F.col("score") * 2))


def test_packing_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("a", "x" * 600, 1), ("b", "é" * 300, 2), ("c", "y" * 400, 3), ("d", "z" * 24, 4)], "chunk_key string, text string, rank int")
    assert by_rank(fusion.pack(rows, 1024)) == ["a", "c", "d"]
    assert by_rank(fusion.pack(rows, 1024, limit=1)) == ["a"]
    with pytest.raises(ValueError):
        fusion.pack(rows, 10)
