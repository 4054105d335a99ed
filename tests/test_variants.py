"""Variants of commands by the bounds of their hashes: two shuffles at most, no distinct count."""

from lodestone.operators import evaluation


def test_variants_by_bounds(spark):
    rows = [("r", "f", "a"), ("r", "f", "a"), ("r", "g", "a"), ("r", "g", "b"), ("r", "h", None), ("r", "h", "a"), ("s", None, None), (None, "f", "x"), (None, "f", "y")]
    df = evaluation.variants(spark.createDataFrame(rows, "root string, file string, content_hash string"))
    assert {tuple(r) for r in df.collect()} == {("r", 6, 3, 1), ("s", 1, 1, 0), (None, 2, 1, 1)}
    df = evaluation.variants(spark.createDataFrame(rows, "root string, file string, content_hash string"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2
