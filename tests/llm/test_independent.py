"""Operators without SQL against methods of another kind: all label paths, held-out labels, odd archives."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import crf, quality, warc
from lodestone.storage import new_path


def test_posteriors_against_all_label_paths():
    """Every path of labels of short chains, weighed by emissions, transitions and start."""
    rng = np.random.default_rng(2)
    for k, n in ((2, 1), (2, 9), (3, 6), (4, 5)):
        scores, moves, start = rng.normal(size=(n, k)) * 2, rng.normal(size=(k, k)), rng.normal(size=k)
        total, post = 0.0, np.zeros((n, k))
        for path in itertools.product(range(k), repeat=n):
            w = math.exp(start[path[0]] + sum(scores[i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            total += w
            for i, y in enumerate(path):
                post[i, y] += w
        for block in (2, 3, 32):
            means, words = crf._posteriors(scores, np.array([n]), moves, start, block)
            assert np.allclose(words, post / total) and np.allclose(means[0], (post / total).mean(0))


def test_language_labels_in_any_number(spark):
    """Thousands of dirty labels: the most frequent are learned, and a repeated id gives the same sample in any order."""
    rows = [(i, "la maison est dans le village avec une porte" if i % 2 else "the river and the mill with a boat", "fr" if i % 2 else "en") for i in range(60)]
    rows += [(1000 + i, "x y z", f"dirt{i}") for i in range(3000)] + [(5, "une autre maison", "fr")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = crf.train(docs), crf.train(docs.orderBy(F.desc("doc_id")).repartition(5))
    assert len(one.langs) == crf.LANGS and {"en", "fr"} <= set(one.langs) and one.langs == two.langs
    assert np.array_equal(one.grams, two.grams) and np.array_equal(one.moves, two.moves)


def test_more_languages_than_usual_if_asked(spark):
    """Sixty made-up languages with words of their own: with room for them, the rarest are predicted too."""
    deal = random.Random(4)
    words = {f"l{k:02d}": ["".join(deal.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for k in range(60)}
    rows = [(100 * k + i, " ".join(deal.choices(own, k=20)), lang) for k, (lang, own) in enumerate(words.items()) for i in range(6 + (k < 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    few, all_of_them = crf.train(docs), crf.train(docs, most_langs=60)
    assert few.langs == sorted(words)[: crf.LANGS] and all_of_them.langs == sorted(words)
    asked = spark.createDataFrame([(k, " ".join(deal.choices(own, k=12)), None) for k, own in enumerate(words.values())], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in crf.identify(asked, all_of_them).collect()}
    assert sum(got[k] == lang for k, lang in enumerate(words)) >= 58


def test_emissions_from_their_definition():
    """Each word's scores: the weights of its n-grams, with marks at its ends, scaled by their number, and its lexicon entry."""
    rng = np.random.default_rng(6)
    field = crf.Field(["a", "b", "c"], {"été": rng.normal(size=3), "na": rng.normal(size=3)})
    field.grams, field.lex = rng.normal(size=field.grams.shape).astype(np.float32), rng.normal(size=(3, 3))
    wrap = (1 << 64) - 1

    def slots(word):
        code = [ord(c) for c in f"\x02{word}\x03"]
        for n in range(1, crf.NGRAM + 1):
            for i in range(len(code) - n + 1):
                h = 0
                for k, c in enumerate(code[i : i + n], 1):
                    h = (h + c + k) * 0x9E3779B97F4A7C15 & wrap
                    h ^= h >> 29
                yield (h >> 20) % crf.SLOTS

    words = ["été", "na", "x", "𝔘nter", "a" * 300]
    for word, got in zip(words, field.emissions(words)):
        own = list(slots(word))
        want = 2 / math.sqrt(len(own)) * field.grams[own].astype(float).sum(0) + field.lexicon.get(word, np.zeros(3)) @ field.lex
        assert np.allclose(got, want, atol=1e-4)
    assert np.allclose(field.emissions(words)[2:3], field.emissions(["x"]))


def test_quality_verdicts_on_held_out_labels(spark):
    """Trees fitted on two thirds of the labels; of the other third, by the whole verdict, at least 85 of 100 are right."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    out = quality.quality_rules(docs, labels.where(~held)).join(labels.where(held).select("doc_id", "quality"), "doc_id").where("quality is not null").collect()
    assert len(out) > 80 and np.mean([r.kept == (r.quality == 1) for r in out]) >= 0.85


def test_archives_of_null_and_repeated_ids_and_long_urls(spark):
    long = "http://a/" + "é " * 40_000
    page = "<p>" + "x" * 2000
    rows = [(None, "u", page), (None, None, "y"), (1, long, page), (1, "v", page), (2, long, page + "z"), (3, "w", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = sorted(map(repr, warc.round_trip(pages, new_path(spark, "warc-odd")).select("page_id", "payload_bytes", "record_type", "refers_to").collect()))
    n = len(page)
    want = [(None, n, "revisit", 1), (None, 1, "response", None), (1, n, "response", None), (1, n, "response", None), (2, n + 1, "response", None), (3, 0, "response", None)]
    assert got == sorted(f"Row(page_id={i}, payload_bytes={b}, record_type={k!r}, refers_to={r})" for i, b, k, r in want)
