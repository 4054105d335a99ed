"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, columns with clashing names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import cotrain, crf, decontam, kneser_ney, licenses, mixing, quality, simhash, urls, warc
from lodestone.storage import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BIG = 9_007_199_254_740_993  # an id that a float can't hold
PROSE = "The river ran past the old mill and the children watched the slow boats drift under the stone bridge at dusk."
ODD = [
    (1, PROSE, "en", "a", 110), (2, PROSE, "en", "a", 110), (2, PROSE, "en", "a", 110), (3, None, None, None, None), (4, "", "en", "b", 0), (5, " \t\n", None, "b", 3),
    (6, "12 34 ½ -- !!", "en", "b", 13), (None, "Le chat dort sur la vieille table de la cuisine.", "fr", None, 50), (None, None, None, None, None), (BIG, "Mit license. CC by", "en", "a", 18),
    (7, "word " * 50_000, "en", "c", 250_000), (8, "x" * 200_000, "en", "c", 200_000), (9, "\x00 nul \u2028 Éé \U0001f600", "fr", "c", 16),
]
CLASH = ["key", "h", "words", "pos", "w", "g", "n", "label", "fp", "score", "part", "rank", "hits", "template", "host", "path", "good", "url2", "size", "target", "quality", "toxic"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, 0), (None, 1, 1), (5, None, None), (7, 0, None)], "doc_id long, quality int, toxic int").withColumn("key", F.lit(1))


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, PROSE), (2, "old mill"), (3, None), (4, ""), (None, "vieille table de"), (5, PROSE), (6, "never"), (7, "word " * 12)]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("words", F.lit("clash"))


def ids(df, name="doc_id"):
    return Counter(r[name] for r in df.select(name).collect())


ALL = Counter(r[0] for r in ODD)


def test_language(spark, odd, none):
    field = crf.train(odd)
    out = crf.identify(odd, field)
    assert ids(out) == ALL
    got = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert {got[i].lang_pred for i in (3, 4, 5, 6)} == {"und"} and got[3].score == 0
    assert got[1].lang_pred == "en" and got[8].lang_pred in ("en", "fr")
    assert crf.train(none) is None and crf.identify(none, field).count() == 0
    assert {r.lang_pred for r in crf.identify(odd, None).collect()} == {"und"}
    kept = crf.keep_identified(odd, field)
    assert kept.columns == odd.columns and not {3, 4, 5, 6} & set(ids(kept)) and ids(kept)[2] == 2
    assert crf.keep_identified(none, None).count() == 0


def test_code_switched_words_change_with_the_text():
    en, fr = "the river and the mill with a boat on this water".split(), "la maison est dans le village avec une porte sur cette rue".split()
    field = crf.fit([("en", en * 4), ("fr", fr * 4)] * 20)
    mean, has = crf.Scorer(field)([" ".join(en * 3 + fr * 3), " ".join(en), " ".join(fr), None, "123"])
    assert has.tolist() == [True, True, True, False, False]
    assert 0.3 < mean[0][0] < 0.7 and mean[1][0] > 0.9 and mean[2][1] > 0.9


def test_cotraining(odd, none, marks):
    out = cotrain.quality(odd, marks)
    assert ids(out) == ALL and ids(cotrain.quality(odd.drop("n_chars"), marks)) == ALL
    blank = {"quality": None, "toxic": None}
    rows, no_rows = cotrain.features(odd), cotrain.features(none)
    assert cotrain.train(no_rows, marks) == blank and cotrain.train(rows, marks.limit(0)) == blank
    assert {(r.score, r.toxic_score, r.kept) for r in cotrain.classify(rows, blank).collect()} == {(1.0, 0.0, True)}
    assert cotrain.classify(no_rows, blank).count() == 0


def test_quality_rules(odd, none, marks):
    out = quality.quality_rules(odd, marks)
    assert ids(out) == ALL
    got = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert got[3].n_words == got[4].n_words == got[5].n_words == 0 and got[7].n_repeat_words == 50_000 and got[8].word_chars == 200_000
    assert not any(got[i].kept for i in (3, 4, 5, 7)) and got[1].n_words == 21
    assert quality.quality_rules(none, marks).count() == 0
    free = quality.quality_rules(odd, marks.limit(0))
    assert all(r.kept != r.base_failed for r in free.collect())
    kept = quality.keep_good(odd, marks)
    assert kept.columns == odd.columns and not {3, 4, 5, 7} & set(ids(kept))


def test_licenses(odd, none):
    out = licenses.scan(odd)
    assert ids(out) == ALL
    got = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert (got[BIG].n_base, got[BIG].first_word, got[BIG].last_word, got[BIG].base_labels) == (2, 0, 2, "cc-by,mit")
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].labels, got[3].score) == (0, 0, None, "", 0)
    assert got[7].n_words == 50_000 and licenses.scan(none).count() == 0


def test_license_bands_bridge_small_changes(spark):
    words = re.sub("[^A-Za-z ]", "", dict(licenses.NOTICES)["mit-notice"]).split()
    notice = " ".join(words)
    altered = " ".join([*words[:9], "hereinafter", *words[9:]])  # one word more: the rest lies on the next diagonal
    rows = licenses.scan(spark.createDataFrame([(1, notice), (2, altered), (3, " ".join(words[:6]))], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == ["mit-notice", "mit-notice", ""] and rows[0].score == 1 and 0 < rows[2].score < 0.5


@pytest.mark.parametrize("block", [50_000, 3])
def test_decontamination(odd, none, items, block):
    out = decontam.decontaminate(odd, items, block=block)
    assert ids(out) == ALL
    got = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (21, 21, 3)
    assert got[1].items_sha256 == hashlib.sha256(b"1,2,5").hexdigest() and got[7].n_hit == 50_000 and got[3].n_words == got[3].n_hit == 0
    assert {r.n_hit for r in out.where("doc_id is null").collect()} == {0, 3}
    assert decontam.decontaminate(none, items).count() == 0
    clean = decontam.decontaminate(odd, items.limit(0))
    assert ids(clean) == ALL and not clean.where("contaminated").count()
    kept = decontam.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and ids(kept) == ALL - Counter({1: 1, 2: 2, 7: 1, None: 1})


def test_language_model(odd, none):
    model = kneser_ney.train(odd)
    out = kneser_ney.score(odd, model)
    assert ids(out) == ALL
    got = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert got[3].n_tokens == got[4].n_tokens == got[5].n_tokens == 1 and got[7].n_tokens == 50_001
    blank = kneser_ney.train(none)
    empty = kneser_ney.score(odd, blank).where("doc_id = 1").first()
    assert (empty.n_known, empty.train_tokens, empty.base_score, empty.score) == (0, 0, 0.0, 0.0)
    assert kneser_ney.score(none, model).count() == 0


def test_counts_survive_the_byte_that_holds_them():
    counts = np.array([1, 254, 255, 256, 70_000, 3], np.uint64)
    assert kneser_ney._unpack_counts(kneser_ney._pack_counts(counts), 6).tolist() == counts.tolist()
    values = np.array([0, 1, kneser_ney.MASK], np.uint64)
    assert kneser_ney._unpack(kneser_ney._pack(values)).tolist() == values.tolist()


def test_urls(spark):
    rows = [(1, "http://A.Example.ORG/es/1?x"), (2, None), (3, "no scheme"), (4, "x://"), (5, "http://b.com"), (5, "http://b.com"), (None, "http://org/"), (6, "http://c.com/de/9#z"), (7, "http://exampleXorg/es/1"), (8, "s://h.net/" + "a/" * 30_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in CLASH})
    good = spark.createDataFrame([(1, 1), (1, 0), (5, 1), (None, 1)], "page_id long, good int")
    out = urls.judge(pages, good)
    assert ids(out, "page_id") == Counter(r[0] for r in rows)
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in out.collect()}
    assert got[1] == ("a.example.org", "example.org/es/", "block") and got[2][:2] == got[3][:2] == got[4][:2] == ("", None) and got[5][1] is None
    assert got[None] == ("org", "org/", "allow") and got[6] == ("c.com", "com/de/", "block") and got[7][1] is None
    assert urls.judge(pages.limit(0), good).count() == 0 and urls.judge(pages, good.limit(0)).count() == len(rows)


def templates_of(spark, paths_and_marks, rules=None):
    rows = [(i, f"http://h.net/{p}") for i, (p, _) in enumerate(paths_and_marks)]
    good = [(i, g) for i, (_, g) in enumerate(paths_and_marks) if g is not None]
    out = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(good, "page_id long, good int"), rules=rules or {})
    return {(r.template, r.verdict) for r in out.select("template", "verdict").distinct().collect()}


def test_bad_branches_are_rejected_and_good_ones_left(spark):
    assert templates_of(spark, [(f"{'spam' if i % 4 == 0 else 'news'}/{i}", int(i % 4 != 0)) for i in range(400)]) == {("h.net/spam/**", "block"), ("h.net/news/**", "allow")}


def test_branches_that_differ_below_the_fifth_segment(spark):
    deep = [(f"a/b/2024/05/12/x/{'spam' if i % 2 else 'news'}/{i}", i % 2 ^ 1) for i in range(200)]
    assert templates_of(spark, deep) == {("h.net/*/*/*/*/*/*/spam/**", "block"), ("h.net/*/*/*/*/*/*/news/**", "allow")}


def test_segments_that_look_like_templates(spark):
    """A section named as a wildcard or as merged branches is a branch of its own."""
    rows = [(f"{('*', '{a|b}', 'a', 'b')[i % 4]}/{i}", int(i % 4 > 1)) for i in range(400)]
    assert templates_of(spark, rows) == {(r"h.net/{\*|\{a\|b\}}/**", "block"), ("h.net/{a|b}/**", "allow")}
    rows = [(f"{'*' if i % 2 else f'x{i}'}/y", i % 2 ^ 1) for i in range(400)]
    assert templates_of(spark, rows) == {(r"h.net/\*/**", "block"), ("h.net/*/**", "allow")}


def test_a_node_of_many_segments(spark):
    """Each page its own section: sums by branch leave the literal ones and the wildcard, and nothing else is ordered."""
    pages = spark.range(200_000).selectExpr("concat('/', if(id % 4 = 0, 'spam', translate(cast(id AS string), '0123456789', 'abcdefghij')), '/p') AS path", "'h.net' AS host", "if(id % 10 = 0, cast(id % 4 <> 0 AS bigint), null) AS good")
    out = urls.templates(pages).groupBy("template").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {(r.template, r.n) for r in out} == {("h.net/spam/**", 50_000), ("h.net/*/**", 150_000)}


def test_the_sieve_keeps_what_is_looked_for(spark):
    hashes = lambda a, b: spark.range(a, b).select(F.xxhash64("id").alias("g"))
    own = hashes(0, 100_000)
    rows = decontam.sieved(hashes(0, 1_100_000), own, 100_000)
    assert rows.join(own, "g", "left_semi").count() == 100_000 and rows.count() < 100_000 + 0.13 * 1_000_000
    small = decontam.sieved(hashes(0, 1_100_000), own, 100_000, most=64)
    assert small.join(own, "g", "left_semi").count() == 100_000
    assert decontam.sieved(hashes(0, 10), own.limit(0), 0).count() == 0


def test_similar_siblings_are_merged_and_their_differing_grandchildren_are_not(spark):
    """Four sections, bad ones in two of each kind: the like are one branch; under the merged branch two children differ."""
    rows = []
    for i in range(400):
        section = ("ads", "casino", "blog", "wiki")[i % 4]
        rows.append((f"{section}/{i}", int(section in ("blog", "wiki"))))
    assert templates_of(spark, rows) == {("h.net/{ads|casino}/**", "block"), ("h.net/{blog|wiki}/**", "allow")}
    rows = [(f"{('en', 'fr')[i % 2]}/{('good', 'bad')[i // 2 % 2]}/{i}", 1 - i // 2 % 2) for i in range(400)]
    assert templates_of(spark, rows) == {("h.net/*/good/**", "allow"), ("h.net/*/bad/**", "block")}


def test_warc_rejects_magic_inside_payloads(spark):
    trap = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nHello\r\n\r\n"
    big = "é" * 600 + trap
    rows = [(1, "http://a", big), (2, "b\r\nX: y", big), (3, None, None), (4, "c", ""), (5, "d", trap), (6, "e", "small"), (7, "f", "small"), (8, "g", trap * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in CLASH}).repartition(2)
    path = new_path(spark, "warc-test")
    got = {r.page_id: r for r in warc.round_trip(pages, path).collect()}
    assert sorted(got) == [r[0] for r in rows]
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert (got[1].record_type, got[1].refers_to) == ("revisit", 2) and {got[i].record_type for i in (2, 3, 4, 5, 6, 7, 8)} == {"response"}
    found = warc.candidates(spark, path, 1 << 16)
    assert found.count() > len(rows) * 2
    small = warc.read_archives(spark, path, 1 << 16)  # ranges far smaller than a record, and entries within them
    assert sorted(int(r.id) for r in small.collect()) == [r[0] for r in rows]
    assert warc.round_trip(pages.limit(0), new_path(spark, "warc-none")).count() == 0


def test_mixing(odd, none):
    out = mixing.mix(odd)
    assert ids(out) == ALL
    rows = out.collect()
    assert all(r.taken <= 2 * r.size for r in rows) and {r.size for r in rows if r.doc_id in (3, 4, 5)} == {0}
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(odd.repartition(5)).collect()))
    assert mixing.mix(none).count() == 0


def test_pivot_keeps_words_and_expectations():
    size, part = np.array([5.0, 9, 14, 3, 8, 21, 2]), np.array([0.3, 0.5, 0.2, 0.9, 0.4, 0.6, 0.1])
    total = np.zeros(7)
    for seed in range(4000):
        out = mixing.pivot(size, part, np.random.default_rng(seed))
        assert (np.abs(out - np.round(out)) > 1e-6).sum() <= 1 and out.min() >= 0 and out.max() <= 1
        assert abs((out * size).sum() - (part * size).sum()) < 1e-6
        total += out
    assert np.abs(total / 4000 - part).max() < 0.03


def test_targets_against_a_level_found_by_halving(spark):
    """Caps that are met one after another, sources of size 0, a null source, more sources than one task sorts."""
    rng = random.Random(9)
    sizes = {None: 40, "": 7, "\U0001f600": 90, "\ue000": 11, "z": 0, **{f"s{i}": int(10 ** rng.uniform(0, 4)) for i in range(60)}}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").repartition(4)
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    names = sorted(sizes, key=lambda s: (s is None, list(map(ord, s or ""))))
    lo, hi, whole = 0.0, 1e9, 1.5 * sum(sizes.values())
    aim = lambda level: [min(2.0 * sizes[s], level * (3, 1, 2)[i % 3]) for i, s in enumerate(names)]
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(aim(mid)) < whole else (lo, mid)
    assert [got[s] for s in names] == pytest.approx(aim(hi)) and sum(got.values()) == pytest.approx(whole)


def test_copies_of_one_row_are_dealt_to_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 50)
    docs = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("w w w").alias("text"), F.lit("a").alias("source"))
    out = mixing.mix(docs.unionByName(docs.limit(5).select("doc_id", "text", F.lit("b").alias("source"))))
    assert out.count() == 2005
    assert {r.source: r.n for r in out.groupBy("source").agg((F.abs(F.sum("taken") - F.max("target")) <= 3).alias("n")).collect()} == {"a": True, "b": True}


def test_take_gives_texts_with_their_copies(odd, none):
    per, got = Counter(), Counter()
    for r in mixing.mix(odd).collect():
        per[r.doc_id, r.source] += r.copies
    out = mixing.take(odd)
    assert out.columns == [*odd.columns, "copies", "taken"]
    for r in out.collect():
        got[r.doc_id, r.source] += r.copies
        assert r.text and r.copies > 0 and r.taken % r.copies == 0
    assert got == +per and mixing.take(none).count() == 0


def test_tree_of_buckets_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 20)
    monkeypatch.setattr(mixing, "FAN", 3)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + pmod(hash(id), 40) as int))").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"))
    per = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(per) == 12 and all(abs(r.taken - r.target) <= 40 for r in per)


def test_near_duplicates(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert Counter(r.doc_id for r in rows) == ALL
    got = {r.doc_id: r for r in rows}
    assert got[3].fingerprint == got[4].fingerprint == "0" * 16 and got[1].component_id == got[2].component_id == 1 and got[4].component_id == 3
    assert got[BIG].component_id == BIG and simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and ids(kept)[1] == 1 and ids(kept)[2] == 0 and ids(kept)[BIG] == 1


def test_chains_of_links_are_one_component(spark):
    """Neighbours differ in 3 bits each, the ends in far more; tiles of two fingerprints and pairs of bands as well."""
    values = [0]
    for i in range(20):
        values.append(values[-1] ^ (0b111 << (3 * i)))
    values += [0x0F0F0F0F0F0F0F0F, 0x0F0F0F0F0F0F0F0F ^ 0b11]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v, 100 + i) for i, v in enumerate(signed)], "fp long, low long")
    for tile in (2, 4096):
        got = dict(simhash.components(simhash.links(nodes, 4, tile), nodes).collect())
        assert [got[v] for v in signed] == [100] * 21 + [121] * 2


def test_band_sets_lose_nothing():
    rng = random.Random(3)
    for bands in range(5, simhash.BANDS + 1):
        masks = [m & (1 << 64) - 1 for m in simhash.band_sets(bands)]
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any((a & m) == (b & m) for m in masks)


def test_comparisons_follow_the_number_of_fingerprints(spark):
    """Unevenly drawn fingerprints: the same bound a fingerprint at any number of them; more bands find the same components."""
    rng = np.random.default_rng(4)
    met = {}
    for n in (2000, 20_000):
        fp = rng.integers(0, 1 << 63, n, dtype=np.int64) & rng.integers(0, 1 << 63, n, dtype=np.int64)  # a quarter of the bits
        nodes = spark.createDataFrame(pd.DataFrame({"fp": np.unique(fp)}))
        _, sizes = simhash.groups(nodes, group=2)
        met[n] = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    assert all(m <= n * 70 for n, m in met.items())  # half of `group` for each of 70 band sets, whatever n is
    near = np.unique(np.concatenate([np.array([7, 9, 1 << 40]) ^ (1 << b) for b in range(30)]))
    nodes = spark.createDataFrame(pd.DataFrame({"fp": near, "low": np.arange(len(near))}))
    few, many = (sorted(map(tuple, simhash.components(simhash.links(nodes, group=g), nodes).collect())) for g in (256, 0.01))
    assert few == many and len(few) == len(near)


def test_pipeline_keeps_columns_and_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before, now = docs.count(), docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        if name != "source mixing":
            assert out.columns == docs.columns
        out.write.mode("overwrite").parquet(path := new_path(spark, "stage"))
        now = spark.read.parquet(path)
        assert 0.3 * before < now.count() <= before
    ran = corpus_pipeline.run(spark, sf)
    assert sorted(map(repr, ran.collect())) == sorted(map(repr, now.collect()))


def fingerprint(text):
    """The SimHash of a text from its definition, bit by bit."""
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_pipeline_against_plain_python(spark, sf):
    """Each stage's decisions from the operators' own queries and plain set logic, one after another."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    marks, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
    table = lambda d: spark.createDataFrame([(int(i), *r) for i, r in zip(d.index, d[["text", "lang", "source", "n_chars"]].values.tolist())], DOCS)
    good = quality.train(table(docs), marks)
    keep = []
    for i, text in docs["text"].items():
        (n, _, _, _, rep), x = quality.statistics(text)
        if n >= 10 and 100 * rep <= 20 * n and good.probability(np.array([x]))[0] >= 0.5:
            keep.append(i)
    docs = docs.loc[keep]
    *_, posteriors = crf.Scorer(crf.train(table(docs))).scored(list(docs["text"]), words=True)
    docs = docs[[p is not None and sum(max(word) for word in p) / len(p) >= 0.5 for p in posteriors]]
    fp = [fingerprint(t) for t in docs["text"]]
    label = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for a in range(len(fp)):
            for b in range(a):
                if (fp[a] ^ fp[b]).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    order = docs.index.to_numpy()
    docs = docs.loc[sorted({min(order[i] for i in range(len(order)) if label[i] == c) for c in set(label)})]
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t))
    windows = set()
    for t in items["text"]:
        w = words(t)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    held = lambda t: any(tuple(w[k : k + n]) in windows for w in [words(t)] for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    docs = docs[[not held(t) for t in docs["text"]]]
    ran = corpus_pipeline.run(spark, sf).collect()
    sizes, source, words = {}, docs["source"].to_dict(), Counter()
    for i, t in docs["text"].items():
        sizes[i] = len(re.findall("[^\x20\x09-\x0d]+", t))
        words[source[i]] += sizes[i]
    names = sorted(words)
    full, aim = set(), {}
    while True:
        left, weight = 1.5 * sum(words.values()) - sum(2 * words[s] for s in full), {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        aim = {s: 2 * words[s] if s in full else left * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        if not (above := {s for s in names if s not in full and aim[s] > 2 * words[s]}):
            break
        full |= above
    taken = Counter()
    for r in ran:
        assert r.text == docs["text"][r.doc_id] and r.taken == r.copies * sizes[r.doc_id] and r.copies in (1, 2)
        taken[r.source] += r.taken
    assert len({r.doc_id for r in ran}) == len(ran)
    assert all(abs(taken[s] - aim[s]) <= max(n for i, n in sizes.items() if source[i] == s) for s in names)


SYLLABLES = ["ka", "lo", "mi", "ne", "ru", "sa", "ti", "vo"]
LONG = " ".join(a + b + c + d for a in SYLLABLES for b in SYLLABLES for c in SYLLABLES for d in SYLLABLES)
LEAKED = "Before the harvest the farmers counted every sheep twice and wrote the numbers down in a small green book."
OTHER = "Nobody in the quiet village remembered who had painted the tall red door beside the bakery so long ago."


@pytest.fixture(scope="module")
def odd_corpus(spark):
    """Each row that goes has one reason to; those that stay are 1, a null id, BIG and 50."""
    rows = [
        (1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (3, PROSE.upper(), None, None, None), (4, LEAKED, "en", "a", 1), (None, LEAKED + " More.", None, None, None),
        (None, OTHER, "en", None, 1), (None, OTHER, "en", None, 1), (BIG, "Le chat gris dort sur la vieille table de la cuisine pendant que la pluie tombe.", "fr", "b", 1), (50, LONG, "en", "c", 1),
        (5, None, None, None, None), (6, "", "en", "b", 0), (7, " \t\n", None, "b", 3), (8, "too few words", "en", "b", 1), (9, "word " * 50_000, "en", "c", 1), (10, "x" * 200_000, "en", "c", 1), (11, "1 2 3 4 5 6 7 8 9 10 11 12 13", "en", "b", 1),
    ]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_and_empty_tables(spark, odd_corpus, empty):
    where, docs = new_path(spark, "odd"), odd_corpus.limit(0) if empty else odd_corpus
    marks = spark.createDataFrame([(1, None, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").withColumn("key", F.lit(1))  # none that can be used
    items = spark.createDataFrame([(1, LEAKED), (2, None), (3, ""), (None, "never seen words"), (1, LEAKED)], "item_id long, text string").withColumn("words", F.lit("clash"))
    for name, df in (("documents", docs), ("labels", marks), ("benchmark", items.limit(0) if empty else items)):
        df.write.parquet(f"{where}/{name}.parquet")
    now, seen = spark.read.parquet(f"{where}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, where).write.parquet(path := new_path(spark, "stage"))
        now = spark.read.parquet(path)
        assert now.columns == docs.columns
        seen.append(ids(now))
    good = Counter([1, 2, 2, 3, 4, None, None, None, BIG, 50])
    want = [good + Counter([11]), good, Counter([1, 4, None, None, BIG, 50]), Counter([1, None, BIG, 50])]
    assert seen == ([Counter()] * 4 if empty else want)
    out = corpus_pipeline.run(spark, where)
    rows = out.collect()
    assert out.columns == [*docs.columns, "copies", "taken"] and not Counter(r.doc_id for r in rows) - Counter([1, None, BIG, 50])
    assert bool(rows) != empty and all(r.taken == r.copies * len(r.text.split()) and r.copies in (1, 2) for r in rows)
    texts = {r.doc_id: r.text for r in now.collect()}
    assert all(r.text == texts[r.doc_id] for r in rows)
