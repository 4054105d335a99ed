"""The language model of several orders, with more shards than a process may open files, in two goes, against plain Python with its own discounts."""

import math
import os
import random
import resource
import zlib
from collections import Counter, defaultdict

import pytest

from lodestone.llm import kneser_ney


def plain(learned, order=2):
    """log10 probability of a list of words under the interpolated modified model of ``order`` words, from its definition.

    Also the probability of a word after a tuple of order - 1 words, and all words.
    """
    padded = lambda w: ["<s>"] * (order - 1) + [*w, "</s>"]
    grams = lambda w: [tuple(padded(w)[i : i + order]) for i in range(len(w) + 1)]
    levels = [Counter(g for w in learned for g in grams(w))]
    while len(next(iter(levels[0]))) > 1:  # below the top, a tuple counts the words that it is found after
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    v = len(levels[0])

    def cuts(counts):
        n = [sum(c == k for c in counts.values()) for k in range(5)]
        if 0 in n[1:4]:
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        raw = [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
        return [0] + [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)]

    tables = []
    for counts in levels:
        d, total, left = cuts(counts), Counter(), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        tables.append((counts, d, total, left))

    def p(gram):
        counts, d, total, left = tables[len(gram) - 1]
        under = p(gram[1:]) if len(gram) > 1 else 1 / (v + 1)
        if not total[gram[:-1]]:
            return under
        c = counts[gram]
        return (c - d[min(c, 3)] + left[gram[:-1]] * under) / total[gram[:-1]]

    return lambda w: sum(math.log10(p(g)) for g in grams(w)), p, {g[0] for g in levels[0]}


@pytest.fixture(scope="module")
def texts():
    deal = random.Random(3)
    words = [f"w{i}" for i in range(800)]
    return [" ".join(words[min(799, int(deal.paretovariate(0.7)))] for _ in range(deal.randint(0, 120))) for _ in range(400)]


@pytest.mark.parametrize(("shards", "go", "order"), [(1, 17, 2), (64, 17, 2), (512, 17, 2), (256, 3, 2), (256, 0, 2), (1, 17, 3), (256, 17, 3), (64, 3, 3), (16, 17, 4)])
def test_any_number_of_shards_gives_the_same_scores(spark, texts, shards, go, order, monkeypatch):
    monkeypatch.setattr(kneser_ney, "FLUSH", 5_000)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    model = kneser_ney.train(docs, shards=shards, go=go, order=order)
    assert 1 << model.bits == shards and len(model.discounts) == order
    score, p, words = plain([t.split() for t in texts], order)
    for before in (["<s>"] * order, ["w1"] * order, ["w1", "w2"] * order, ["new"] * order):
        assert sum(p((*before[-order + 1 :], w)) for w in [*words, "never seen"]) == pytest.approx(1)
    kept = resource.getrlimit(resource.RLIMIT_NOFILE)
    own = kneser_ney.Lookup(model, maps=20)
    asked = texts[:100] + ["never seen before", "w1 w2 unseen w1 w1", None, ""]
    try:
        resource.setrlimit(resource.RLIMIT_NOFILE, (max(map(int, os.listdir("/proc/self/fd"))) + 60, kept[1]))
        out = own.score(asked)
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, kept)
    assert len(own.maps) <= 20
    assert list(out["score"]) == pytest.approx([score((t or "").split()) for t in asked])


@pytest.mark.parametrize("order", [2, 3])
def test_models_of_nothing_and_of_one_word(spark, order):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a")], "doc_id long, text string")
    for some in (docs.limit(0), docs.where("text is null"), docs):
        learned = [(r.text or "").split() for r in some.collect()]
        got = kneser_ney.score(docs, kneser_ney.train(some, order=order)).collect()
        assert len(got) == 4 and all(r.score <= 0 and math.isfinite(r.score) for r in got)
        if learned:
            score = plain(learned, order)[0]
            assert [r.score for r in got] == pytest.approx([score((r.text or "").split()) for r in docs.collect()])
    with pytest.raises(ValueError):
        kneser_ney.train(docs, order=1)


def test_the_query_scores_with_three_words_too(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    words = {r.doc_id: kneser_ney.tokens_of(r.text) for r in docs}
    two, three = (plain([w for i, w in words.items() if zlib.crc32(str(i).encode()) % 7 != 2], order)[0] for order in (2, 3))
    got = kneser_ney.query(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(words)
    for r in got:
        assert r.score == pytest.approx(two(words[r.doc_id])) and r.score_3 == pytest.approx(three(words[r.doc_id]))
    assert sum(r.score_3 for r in got) > sum(r.score for r in got)


def test_a_model_scores_with_fewer_words_than_its_own(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    model, asked = kneser_ney.train(docs, shards=16, order=4), texts[:100] + ["never seen before", "w1 w2 unseen w1 w1", None, ""]
    out = kneser_ney.Lookup(model).score(asked, (2, 3))
    for order, name in ((2, "score_2"), (3, "score_3"), (4, "score")):
        score = plain([t.split() for t in texts], order)[0]
        assert list(out[name]) == pytest.approx([score((t or "").split()) for t in asked])
    with pytest.raises(ValueError):
        kneser_ney.score(docs, model, further=(4,))


def test_the_query_counts_once_and_stores_few_bytes(spark, sf, monkeypatch):
    models, train = [], kneser_ney.train
    monkeypatch.setattr(kneser_ney, "train", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    assert "score_3" in kneser_ney.query(spark, sf).columns
    (model,) = models
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    words = [["", "", *kneser_ney.tokens_of(r.text), "end"] for r in docs if zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    grams = len({tuple(w[i : i + 3]) for w in words for i in range(len(w) - 2)})
    where = model.where.removeprefix("file://")
    assert sum(os.path.getsize(f"{where}/{f}") for f in os.listdir(where)) < 25 * grams
