"""Full text ranked without scoring every hit: postings stored in blocks of documents, with a bound of the score of each.

The score is that of ``signals.cover_density``: the sum of 1 / length over the shortest spans that hold every term. A
document has at most as many spans as the least frequent term has places, and none is shorter than the number of terms; so
with the most places that a term has in one document of a block, no document of it scores more than the least of these over
the number of terms. Blocks hold documents of like length, which keeps their bounds apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators.signals import SHELVES, bounded, cover_scores, query_terms
from lodestone.storage import stash

#: Documents of a block.
BLOCK = 512


def _shelf(shelves: int) -> Column:
    return F.pmod(F.xxhash64("token"), F.lit(shelves)).cast("int")


def write_index(chunks: DataFrame, path: str, key: str = "stable_key", text: str = "text", block: int = BLOCK, shelves: int = SHELVES, only: list[str] | None = None) -> None:
    """Stores ``postings`` (token, block, key, positions) and ``blocks`` (token, block, docs, most) by a hash of the token.

    ``only`` keeps the terms of an index that serves some queries alone. Keys must not repeat; a block is a class of length
    (powers of two) and a hash of the key, as many as the class needs.
    """
    terms = chunks.select(key, tx.terms(F.col(text)).alias("terms"))
    sized = terms.withColumn("size", F.floor(F.log2(F.greatest(F.size("terms"), F.lit(1)))).cast("int"))
    words = sized.select(key, "size", F.posexplode("terms").alias("pos", "token"))
    if only is not None:
        words = words.where(F.col("token").isin(only))
    held = stash(words.groupBy("token", key, "size").agg(F.sort_array(F.collect_list("pos")).alias("positions")), "held")
    per = held.select(key, "size").distinct().groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each power of two
    parts = F.coalesce(*[F.when(F.col("size") == r["size"], F.lit(-(-r["n"] // block))) for r in per], F.lit(1)) if per else F.lit(1)
    place = F.concat_ws("-", F.lpad(F.col("size").cast("string"), 2, "0"), F.pmod(F.xxhash64(F.col(key).cast("string")), parts).cast("string"))
    dealt = held.withColumns({"block": place, "shelf": _shelf(shelves)}).drop("size")
    dealt.repartitionByRange("shelf", "token", "block", key).sortWithinPartitions("shelf", "token", "block").write.partitionBy("shelf").option("maxRecordsPerFile", 5_000_000).parquet(f"{path}/postings")
    bounds = dealt.groupBy("shelf", "token", "block").agg(F.count(F.lit(1)).alias("docs"), F.max(F.size("positions")).alias("most"))
    bounds.repartitionByRange("shelf", "token").sortWithinPartitions("shelf", "token").write.partitionBy("shelf").parquet(f"{path}/blocks")


def _of(spark: SparkSession, path: str, words: list[str], shelves: int) -> DataFrame:
    own = sorted({r[0] for r in spark.createDataFrame([(w,) for w in words], "token string").select(_shelf(shelves)).collect()})
    return spark.read.parquet(path).where(F.col("shelf").isin(own) & F.col("token").isin(words)).drop("shelf")


def top_ranked(spark: SparkSession, path: str, query: str, key: str, limit: int = 20, shelves: int = SHELVES) -> tuple[DataFrame, dict]:
    """(rows: key, score; read: blocks, scored, of documents) of the first ``limit`` documents that hold all terms of ``query``.

    The blocks of the highest bounds are scored first, as many as may hold ``limit`` documents. Of the others only those
    are read whose bound reaches the last score so far: no other can hold a row of the result.
    """
    words, limit = sorted(set(query_terms(query))), bounded(limit, 1000)
    postings = _of(spark, f"{path}/postings", words, shelves) if words else None
    told = _of(spark, f"{path}/blocks", words, shelves).groupBy("block").agg(F.count(F.lit(1)).alias("n"), (F.min("most") / len(words)).alias("bound"), F.min("docs").alias("docs")) if words else None
    if told is None:
        none = spark.read.parquet(f"{path}/postings").select(key).limit(0)
        return none.withColumn("score", F.lit(None).cast("double")), {"blocks": 0, "read": 0}
    blocks = stash(told.where(F.col("n") == len(words)), "bounds")
    first = [r["block"] for r in blocks.orderBy(F.desc("bound"), "block").limit(max(2, -(-2 * limit // BLOCK))).collect()]
    scored = stash(cover_scores(postings.where(F.col("block").isin(first)), words, key), "scored")
    least = scored.orderBy(F.desc("score"), key).limit(limit).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    rest = blocks.where(~F.col("block").isin(first))
    if least["n"] == limit:
        rest = rest.where(F.col("bound") >= least["least"] - 1e-9)
    later = postings.join(F.broadcast(rest.select("block")) if rest.count() <= 100_000 else rest.select("block"), "block", "left_semi")
    rows = scored.unionByName(cover_scores(later, words, key)).orderBy(F.desc("score"), key).limit(limit)
    return rows, {"blocks": blocks.count(), "read": len(first) + rest.count()}
