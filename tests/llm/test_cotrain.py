"""Co-training against plain Python: the pool's surest rows, the scores, what a view learns from the other; held-out labels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import cotrain, entries


@pytest.fixture(scope="module")
def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def rows(tables):
    return cotrain.features(tables[0])


def slot(feature):
    import xxhash

    return xxhash.xxh64(feature.encode()).intdigest() % cotrain.SLOTS


def test_scores_add_up(spark, sf, rows, tables):
    """Every score of the query from the model's weights, feature by feature, with views written anew from each row."""
    docs = {r.doc_id: r for r in tables[0].collect()}
    models = cotrain.train(rows, tables[1])
    got = {r.doc_id: r for r in entries.QUERIES["op2_quality_cotraining"](spark, sf).collect()}
    assert sorted(got) == sorted(docs)
    curve = lambda x, a, b: 1 / (1 + math.exp(-max(-30, min(30, x * a + b))))
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for i, d in docs.items():
        long = "none" if d.n_chars is None else str(int(math.log2(1 + d.n_chars) * 2))
        meta = {f"source {d.source}", f"lang {d.lang}", f"both {d.source} {d.lang}", f"long {long}", f"source {d.source} long {long}", f"lang {d.lang} long {long}"}
        found = []
        for target in ("quality", "toxic"):
            content, metadata, last = models[target]
            p = [curve(sum(float(view.weights[k]) for k in {slot(f) for f in own}), *view.curve) for view, own in ((content, cotrain.content_view(d.text or "")), (metadata, meta))]
            found.append(1 / (1 + math.exp(-(logit(p[0]) * last[0] + logit(p[1]) * last[1] + last[2]))))
            if target == "quality":
                assert (got[i].content_score, got[i].metadata_score) == (pytest.approx(p[0], abs=1e-4), pytest.approx(p[1], abs=1e-4))
        assert (got[i].score, got[i].toxic_score) == (pytest.approx(found[0], abs=1e-3), pytest.approx(found[1], abs=1e-3))
        assert got[i].kept == (got[i].score >= 0.5 and got[i].toxic_score < 0.5)


@pytest.mark.parametrize("slack", [1, 4])
@pytest.mark.parametrize("sure", [0.0, 0.5])
def test_the_surest_are_those_of_the_whole_pool(spark, rows, sure, slack):
    """Against a sort of all rows: repeated contents, unequal numbers wanted, and the surest half of all labelled."""
    view = cotrain.View()
    view.weights[:] = np.random.default_rng(5).normal(size=cotrain.SLOTS)
    view.curve = np.array([0.05, 0.0])
    wanted, at = {("quality", 0): 7, ("quality", 1): 15}, ("quality", 0)
    whole = {}
    for r in rows.collect():
        whole[r.key] = (float(view.probability([cotrain.unpacked(bytes(r.content))])[0]), bytes(r.content))
    order = sorted(whole, key=lambda k: -abs(whole[k][0] - 0.5))
    marks = spark.createDataFrame([(k,) for k in order[: len(order) // 2]], "id string")
    free = {whole[k][1]: whole[k][0] for k in order[len(order) // 2 :]}
    got = cotrain.surest(rows.union(rows).coalesce(2), marks, {at: view}, wanted, {at: []}, sure, slack)
    for label, n in ((0, 7), (1, 15)):
        best = sorted((p if label else 1 - p for p in free.values()), reverse=True)[:n]
        mine = [r for r in got if r.label == label]
        assert [r.sure for r in mine] == pytest.approx([p for p in best if p >= sure]) and len({bytes(r.content) for r in mine}) == len(mine)
        assert {bytes(r.content) for r in mine} <= set(free)
    again = cotrain.surest(rows, marks, {at: view}, wanted, {at: [r.tie for r in got]}, sure, slack)
    assert not {r.tie for r in again} & {r.tie for r in got}


def test_packed_slots_come_back():
    for slots in ([], [0], [0, 1, 255, 256, 70_000, cotrain.SLOTS - 1]):
        assert cotrain.unpacked(cotrain.packed(np.array(slots, np.int32))).tolist() == slots


def test_views_teach_each_other():
    """The metadata view has few labelled rows of its own; what the content view tells it makes it right."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 60).astype(float)
    view = lambda base, marks: [np.array(sorted({base + int(m), *rng.integers(5000, 6000, 5)})) for m in marks]
    pair = cotrain.Pair(view(10, y), [np.array([int(k)]) for k in rng.integers(5000, 6000, 60)], y)  # metadata without a clue
    assert len(np.unique(pair.views[1].probability([np.array([20]), np.array([21])]))) == 1
    for m, row in zip(np.repeat([0.0, 1.0], 100), view(20, np.repeat([0, 1], 100))):
        pair.told[1][row.astype(np.int64).tobytes()] = m
    pair.learn()
    content, meta, curve = pair.finish()
    low, high = meta.probability([np.array([20]), np.array([21])])
    assert low < 0.3 and high > 0.7 and len(curve) == 3 and ((content.probability(view(10, y)) > 0.5) == y).all()


def test_held_out_labels(spark):
    """Fitted on two thirds of the labels of a larger table, the other third is named right."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    rows = cotrain.features(docs)
    out = cotrain.classify(rows, cotrain.train(rows, labels.where(~held)))
    joined = out.join(labels.where(held).select(F.col("doc_id").cast("string").alias("key"), "quality", "toxic"), "key").collect()
    right = lambda score, mark: np.mean([(r[score] >= 0.5) == (r[mark] == 1) for r in joined if r[mark] is not None])
    assert len(joined) > 80 and right("score", "quality") >= 0.85 and right("toxic_score", "toxic") >= 0.9
