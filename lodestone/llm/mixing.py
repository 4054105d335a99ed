"""Mixing sources to target weights by pivotal dependent rounding.

A document's expected number of copies is its source's target over the source's size. Whole copies are certain; the
fractional rest is rounded by the pivotal method on words: two documents play, words move between them in a random
direction that keeps both expectations until one's copies are whole, and the other plays on. Documents play within
buckets of their source, and the one that a bucket leaves goes up a reduction tree of ``FAN`` buckets a node, so that a
source of any size is spread over many tasks and its taken words miss its target by at most one document. Targets are
found in Spark as well: there may be as many sources as documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import AT_ONCE, SPACE_GAP, as_key, from_key, split_words, stash, table

#: Fixed values of the contract: weights in turn, the share of all sizes to take, the most copies.
WEIGHTS, TOTAL, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Documents of a first bucket, buckets that a node of the tree combines, seed.
BUCKET, FAN, SEED = 2000, 64, 42


def pivot(size: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds ``part`` (copies, each in [0, 1]) in the given order; all but at most one become whole, words are kept."""
    part, mine = part.astype(float).copy(), -1
    for i in np.nonzero((part > 1e-12) & (part < 1 - 1e-12))[0]:
        if mine < 0:
            mine = i
            continue
        a, b = mine, i
        up = min((1 - part[a]) * size[a], part[b] * size[b])  # words that can go from b to a
        down = min(part[a] * size[a], (1 - part[b]) * size[b])
        words = up if rng.random() * (up + down) < down else -down
        part[a] += words / size[a]
        part[b] -= words / size[b]
        whole = [abs(part[x] - round(part[x])) * size[x] < 1e-7 for x in (a, b)]
        for x, w in zip((a, b), whole):
            if w:
                part[x] = round(part[x])
        mine = -1 if all(whole) else (b if whole[0] else a)
    return part


def settle(size: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Rounds what is left of ``after`` to the nearer whole number and hands the words so won or lost to shorter documents.

    From long to short, each document that is no longer than the words still owed flips its copy if that pays them back.
    """
    out = np.round(after)
    owed = float((before * size).sum() - (out * size).sum())
    if np.abs(after - out).max(initial=0) < 1e-9:
        return out
    for i in np.argsort(-size, kind="stable"):
        if 0 < size[i] <= abs(owed) and 0 < before[i] < 1 and out[i] == (owed < 0):
            out[i] = 1 - out[i]
            owed += size[i] if owed < 0 else -size[i]
    return out


def _play(level: int, seed: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Long documents play first: they meet their like and become whole, and a short one is left.
        pdf = pdf.sort_values(["size", "order", "key"], ascending=[False, True, True], kind="stable", na_position="first")
        rng = np.random.default_rng([seed, level, int(pdf["bucket"].iloc[0]), int(pdf["rank"].iloc[0])])
        size, before = pdf["size"].to_numpy(float), pdf["part"].to_numpy(float)
        after = pivot(size, before, rng)
        return pdf.assign(part=settle(size, before, after) if last else after)

    return run


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank``: the place of ``source`` by code point from 0, null last. No task holds all of them."""
    placed = stash(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("row", F.monotonically_increasing_id()), "ordered")
    part = F.shiftrightunsigned("row", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # a row for each task of the sort
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = stash(sizes.select(F.col("part").alias("of"), before.alias("before")), "offsets")
    return placed.join(F.broadcast(offsets), part == F.col("of")).withColumn("rank", F.col("before") + F.col("row").bitwiseAND((1 << 33) - 1)).drop("row", "of", "before")


def source_targets(sized: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, rank, source_size, docs, target) from rows (source, size).

    Targets are shares of ``total`` times all sizes by weight, each at most ``most`` times its source's size; what is above
    is reshared by weight among the others. So a target is the lesser of its cap and a level times its weight; the level
    rises from round to round, as sources reach their caps, until none is above. A round is one aggregation.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = stash(ranked(per).withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "sources")
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") < level * F.col("weight")
        left = total * F.sum("source_size") - F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0))
        now = rows.agg(left.alias("left"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"), F.count_if(full).alias("n")).first()
        if now["n"] == capped or not now["open"]:
            break
        level, capped = now["left"] / now["open"], now["n"]
    return rows.select("source", "rank", "source_size", "docs", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: ``id_col``, source, text_hash, size, source_size, target, copies, taken.

    Null texts have size 0; documents of size 0 take nothing, as do sources of size 0. Null sources are one source, the
    last. Repeated rows are documents of their own. Other columns are not read. Ids order the play, so that reruns agree.
    """
    size = F.size(split_words(F.col("text"), SPACE_GAP)).cast("long")
    sized = stash(docs.select(as_key(id_col), F.col(source_col).cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), size.alias("size")), "sizes")
    aims = stash(source_targets(sized), "targets")
    # Rows that repeat all of these are told apart by a number, so that none of the buckets gets all copies of a row.
    same = sized.groupBy("key", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("times"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / AT_ONCE)))
    numbers = F.sequence(F.col("part") * AT_ONCE, F.least("times", (F.col("part") + 1) * AT_ONCE) - 1)
    single = same.withColumn("part", part).repartition("key", "source", "text_hash", "part").withColumn("number", F.explode(numbers)).drop("part", "times")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = single.join(aims, single["source"].eqNullSafe(aims["source"])).drop(aims["source"]).withColumn("rate", rate)
    whole = F.when(F.col("size") > 0, F.floor(F.col("rate"))).otherwise(0)
    rows = rows.withColumn("copies", whole.cast("long")).withColumn("part", F.when(F.col("size") > 0, F.col("rate") - F.col("copies")).otherwise(0.0))
    order = F.xxhash64("key", "size", "text_hash", "number", F.lit(seed))
    buckets = F.ceil(F.col("docs") / BUCKET)
    now = rows.withColumn("order", order).withColumn("buckets", buckets).withColumn("bucket", F.pmod(order, buckets))
    keep = ["key", "source", "text_hash", "rank", "size", "source_size", "target", "copies", "part", "order", "buckets", "bucket"]
    done, level, most = None, 0, max(1, -(-(aims.agg(F.max("docs")).first()[0] or 1) // BUCKET))
    settled = (F.col("part") <= 1e-12) | (F.col("part") >= 1 - 1e-12)
    while True:
        now = now.select(*keep)
        played = stash(now.groupBy("rank", "bucket").applyInPandas(_play(level, seed, most == 1), now.schema), "played")
        if most == 1:
            done = played if done is None else done.unionByName(played)
            break
        over = played.where(settled).withColumn("part", F.round("part"))
        done = over if done is None else done.unionByName(over)
        now = played.where(~settled).withColumn("buckets", F.ceil(F.col("buckets") / FAN)).withColumn("bucket", F.floor(F.col("bucket") / FAN))
        level, most = level + 1, -(-most // FAN)
    copies = (F.col("copies") + F.col("part")).cast("long")
    out = from_key(done, docs, id_col, "key").withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(F.col("key").alias(id_col), F.col("source").alias(source_col), "text_hash", "size", "source_size", "target", "copies", "taken")


def take(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all their columns, ``copies`` and ``taken`` (words, copies counted).

    Columns of ``docs`` that have these two names are replaced by them.
    Rows that repeat id, source and text are one row with the copies of all, the first by its other columns. The mix is
    drawn without texts; they meet their copies in one join.
    """
    per = mix(docs, id_col, source_col, seed).groupBy(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col("text_hash").alias("_hash"))
    per = stash(per.agg(F.sum("copies").alias("copies"), F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("_n")).where("copies > 0"), "copies")
    own = docs.drop("copies", "taken")

    def joined(some: DataFrame) -> DataFrame:
        same = own[id_col].eqNullSafe(some["_id"]) & own[source_col].cast("string").eqNullSafe(some["_source"]) & (F.xxhash64(own["text"]) == some["_hash"])
        return own.join(some, same).select(*[own[f"`{c}`"] for c in own.columns], "copies", "taken")

    once, repeated = joined(per.where("_n = 1")), per.where("_n > 1")
    if repeated.isEmpty():
        return once
    again = joined(repeated)
    rest = F.to_json(F.struct(*[again[f"`{c}`"] for c in again.columns if c != "text"]))
    first = F.min_by(F.struct(*[again[f"`{c}`"] for c in again.columns]), rest)
    return once.unionByName(again.groupBy(again[id_col].alias("_id"), again[source_col].alias("_source"), F.xxhash64(again["text"]).alias("_hash")).agg(first.alias("_row")).select("_row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
