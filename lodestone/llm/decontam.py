"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Windows of ``window`` consecutive item words are sets of word shingles that a contaminated text holds whole, so the
necessary prefix of a window is its one rarest shingle. Shingles are ordered by how often the corpus holds them; the
corpus joins the prefix shingles only, start positions and lengths bound the candidates, and the words of every
candidate window are compared. The corpus is read twice, to count the shingles of the items and to look for prefixes. A
prefix table of bounded size is broadcast; a larger one meets the hashes of the corpus in a shuffle that carries no text,
and only the texts that have candidates are read for the verification. Before such a shuffle a sieve, a bit for each hash
that is looked for, keeps back the places of the corpus that can't match: what is shuffled follows the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD_GAP, again, lower_ascii, split_words, stash, table

#: Words of a window, words of a shingle, entries that are broadcast at most (each holds at most two windows of words).
WINDOW, SHINGLE, BLOCK = 10, 3, 50_000
#: Bits of a sieve for each hash in it, and the most words of 64 bits (16 MB) that a sieve has.
EACH, MOST_SIEVE = 16, 1 << 21


def _words(df: DataFrame, key: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), split_words(lower_ascii(text), WORD_GAP).alias("words"))


def _grams(docs: DataFrame, ks: list[int]) -> DataFrame:
    """A row per word place (one of null place for no words), with the hash of the shingle that starts there; for several
    lengths ``ks`` a row for each that fits (the first: always)."""
    placed = docs.select("key", "h", "words", F.posexplode_outer("words").alias("pos", "w"))
    hashes = [F.when(F.col("pos") + k <= F.size("words"), _hash(k, F.col("w"), *[F.get("words", F.col("pos") + j) for j in range(1, k)])) for k in ks]
    if len(ks) == 1:
        return placed.withColumn("g", hashes[0]).withColumn("nth", F.lit(0))
    return placed.select("*", F.posexplode(F.array(*hashes)).alias("nth", "g")).where("nth = 0 or g is not null")


def _hash(k: int, *words: Column) -> Column:
    return F.xxhash64(F.lit(k), *words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_words, hits (array of start, length, item), n_hit, n_items, items_sha256, contaminated, text_hash.

    Null or empty texts have no words and no hits; items without words match nothing; a null item id is the empty name.
    Repeated rows each get their row. No other columns of either table are read.
    """
    d = _words(docs, id_col)
    items = stash(
        _words(benchmark, item_col).where(F.size("words") > 0)
        .select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("item"), "h", "words", F.size("words").alias("n"))
        .select("item", "h", "words", "n", F.least("n", F.lit(window)).alias("length"), F.least("n", F.lit(shingle)).alias("k"))
        .dropDuplicates(["item", "h"]),
        "items",
    )
    ks = sorted(r.k for r in items.select("k").distinct().collect()) or [shingle]  # at most `shingle` values
    places = stash(_places(items, shingle), "places")
    prefix = stash(_prefixes(places, _frequencies(d, places, ks, block)), "prefixes")
    if prefix.count() <= block:
        return _summary(_probe(d, prefix, ks), id_col)
    return _summary(_probe_apart(d, prefix, ks), id_col)


def sieved(rows: DataFrame, own: DataFrame, n: int, most: int = MOST_SIEVE) -> DataFrame:
    """``rows`` whose hash ``g`` may be one of the ``n`` in ``own``: all that are, and few others (1 in ``EACH``, until the sieve is at its largest).

    The sieve is one row, an array of words of 64 bits, which is broadcast: its size is bounded.
    """
    size = 1
    while size < most and size * 64 < n * EACH:
        size *= 2
    word = F.pmod(F.shiftrightunsigned("g", 6), F.lit(size)).cast("int")
    bit = F.expr("shiftleft(1L, cast(g & 63 AS int))")
    set_ = own.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    every = own.sparkSession.range(size).select(F.col("id").cast("int").alias("w")).join(set_, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    sieve = stash(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("sieve")), "sieve")
    return rows.join(F.broadcast(sieve), F.get("sieve", word).bitwiseAND(bit) != 0).drop("sieve")  # one row


def _frequencies(d: DataFrame, places: DataFrame, ks: list[int], block: int) -> DataFrame:
    """How often the corpus holds each shingle of the items."""
    own = stash(places.select("g").distinct(), "shingles")
    grams, n = _grams(d, ks).select("g").where("g is not null"), own.count()
    if n > 20 * block:  # more than are broadcast, a hash each
        grams = sieved(grams, own, n)
    else:
        own = F.broadcast(own)
    return stash(grams.join(own, "g").groupBy("g").agg(F.count(F.lit(1)).alias("df")), "frequencies")


def _places(items: DataFrame, shingle: int) -> DataFrame:
    """The shingles of the items by place, each with the words that its windows can reach."""
    k = F.col("k")
    placed = items.select("item", "h", "words", "n", "length", "k", F.explode(F.sequence(F.lit(0), F.col("n") - k)).alias("q"))
    lo = F.greatest(F.lit(0), F.col("q") + k - F.col("length"))
    hi = F.least(F.col("n"), F.col("q") + F.col("length"))
    word = [F.get("words", F.col("q") + j) for j in range(shingle)]
    g = F.coalesce(*[F.when(k == n, _hash(n, *word[:n])) for n in range(1, shingle + 1)])
    return placed.select("item", "h", "n", "length", "q", g.alias("g"), lo.alias("off"), F.slice("words", lo + 1, hi - lo).alias("near"))


def _prefixes(places: DataFrame, df: DataFrame) -> DataFrame:
    """Each window's rarest shingle: per item and place of it the starts of the windows, and the words around it.

    A window with a shingle that the corpus never holds can't occur and has no prefix.
    """
    rare = places.join(df, "g", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    of_window = rare.withColumn("s", F.explode(F.sequence(F.col("off"), F.least(F.col("q"), F.col("n") - F.col("length")))))
    best = of_window.groupBy("item", "h", "length", "s").agg(F.min(F.struct("df", "g", "q", "off", "near")).alias("m")).where("m.df > 0")
    return best.groupBy("m.g", "item", "h", "m.q", "m.off", "length", "m.near").agg(F.collect_set("s").alias("starts"))


ENTRY = ["item", "q", "off", "length", "starts", "near"]


def _probe(d: DataFrame, prefix: DataFrame, ks: list[int]) -> DataFrame:
    """Verified windows of the corpus, and one row of each document, to count its words and its repeats."""
    entries = prefix.groupBy("g").agg(F.collect_list(F.struct(*ENTRY)).alias("entries"))
    first = (F.col("pos").isNull() | (F.col("pos") == 0)) & (F.col("nth") == 0)
    joined = _grams(d, ks).join(F.broadcast(entries), "g", "left").where(first | F.col("entries").isNotNull())
    # No higher-order function here: Spark would leave generated code for it, and copy all words of a text for each hit.
    each = joined.select("key", "h", "words", "pos", first.alias("first"), F.posexplode_outer("entries").alias("i", "e"))
    return _verified(each.select("key", "h", "words", "pos", "e.*", (F.col("first") & (F.coalesce("i", F.lit(0)) == 0)).alias("first")))


def _probe_apart(d: DataFrame, prefix: DataFrame, ks: list[int]) -> DataFrame:
    """The same for any number of prefixes: places join them by hash, and the candidates meet their texts afterwards."""
    own = stash(prefix.select("g").distinct(), "hashes")
    places = sieved(_grams(d, ks).where("g is not null").select("key", "h", "pos", "g"), own, own.count()).distinct()  # copies of a row have the same
    found = stash(places.join(prefix.select("g", *ENTRY), "g").select(F.col("key").alias("_key"), F.col("h").alias("_h"), "pos", *ENTRY), "candidates")
    # A text that comes with one id again and again is verified once: hits are a set, and the marks count the rows.
    texts = d.join(found.select("_key", "_h").distinct(), d["key"].eqNullSafe(F.col("_key")) & (d["h"] == F.col("_h")), "left_semi").dropDuplicates(["key", "h"])
    with_texts = texts.join(found, texts["key"].eqNullSafe(found["_key"]) & (texts["h"] == found["_h"])).drop("_key", "_h")
    marks = d.select("key", "h", F.greatest(F.size("words"), F.lit(0)).cast("long").alias("n_words"), F.lit(1).cast("long").alias("mark"))
    hits = _verified(with_texts.select("key", "h", "words", "pos", *ENTRY, F.lit(False).alias("first")))
    return hits.unionByName(marks, allowMissingColumns=True)


def _verified(each: DataFrame) -> DataFrame:
    """(key, h, n_words, mark, hit): the windows of the candidates that stand in their texts, and the marks."""
    each = each.select("key", "h", "words", "pos", "item", "q", "off", "length", "near", "first", F.posexplode_outer("starts").alias("j", "s"))
    begin, length = F.col("pos") - F.col("q") + F.col("s"), F.col("length")
    fits = (begin >= 0) & (begin + length <= F.size("words"))
    same = F.when(fits, F.slice("words", begin + 1, length) == F.slice("near", F.col("s") - F.col("off") + 1, length)).otherwise(F.lit(False))
    n_words = F.greatest(F.size("words"), F.lit(0)).cast("long")
    hit = F.when(same, F.struct(begin.alias("start"), length.alias("length"), F.col("item").alias("item")))
    mark_here = F.col("first") & (F.coalesce("j", F.lit(0)) == 0)
    return each.where(mark_here | same).select("key", "h", n_words.alias("n_words"), mark_here.cast("long").alias("mark"), hit.alias("hit"))


def _summary(found: DataFrame, id_col: str) -> DataFrame:
    per = found.groupBy("key", "h", "n_words").agg(F.sum("mark").alias("repeats"), F.array_sort(F.collect_set("hit")).alias("hits"))
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("reach"))
    step = lambda a, x: F.struct(
        (a["total"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(x["start"], a["reach"]))).cast("long").alias("total"),
        F.greatest(a["reach"], x["start"] + x["length"]).alias("reach"),
    )
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["item"])))
    return (
        again(per.withColumn("n_hit", F.aggregate("hits", zero, step)["total"]).withColumn("names", names), "repeats")
        .select(
            F.col("key").alias(id_col), "n_words", "n_hit", F.size("names").cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", "names").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "hits", F.col("h").alias("text_hash"),
        )
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM iw),
dw AS (SELECT r, s, l, array_to_string(w[s:s + l - 1], ' ') AS win FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, ls WHERE len(w) >= l)),
m AS (SELECT dw.r, dw.s, dw.l, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.l = iw.l),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + l)) AS p FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(n, ',' ORDER BY n) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS n FROM m) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""


def query(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hits", "text_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with all their columns."""
    hit = stash(decontaminate(docs, benchmark, id_col, item_col).where("contaminated").select(F.col(id_col).alias("hit_id"), "text_hash").distinct(), "contaminated")
    same = docs[id_col].eqNullSafe(hit["hit_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == hit["text_hash"])
    return docs.join(hit, same, "left_anti")
