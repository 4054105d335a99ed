"""Metrics and audits: recall, precision, comparison with expected rows, coverage, histograms, stratified samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram, in milliseconds.
BUCKETS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000)


def recall_at(expected: DataFrame, results: DataFrame, k: int = 20, group: str = "language", least: float = 0.9) -> DataFrame:
    """Per ``group`` and over all (null group): cases, mean recall in the first ``k``, and whether it is at least ``least``.

    ``expected``: (case_id, group, chunk_key); ``results``: (case_id, chunk_key, rank). A case without results has recall 0.
    """
    hits = results.where(F.col("rank") <= k).select("case_id", "chunk_key").distinct().withColumn("_hit", F.lit(1))
    per = expected.join(hits, ["case_id", "chunk_key"], "left").groupBy("case_id", group).agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))
    out = per.groupingSets([[group], []], group).agg(F.count(F.lit(1)).alias("cases"), F.avg("recall").alias("mean_recall"))
    return out.withColumn("passed", F.col("mean_recall") >= least)


def compare(expected: DataFrame, actual: DataFrame, key: Sequence[str], fields: Sequence[str] = ()) -> DataFrame:
    """Full outer comparison on ``key``: status matched, missing, unexpected or mismatch, and the fields that differ."""
    e = expected.select(*key, F.struct(*fields, F.lit(True).alias("_in")).alias("_e"))
    a = actual.select(*key, F.struct(*fields, F.lit(True).alias("_in")).alias("_a"))
    differ = F.filter(F.array(*[F.when(~F.col(f"_e.{f}").eqNullSafe(F.col(f"_a.{f}")), F.lit(f)) for f in fields] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.size("differs") > 0, "mismatch").otherwise("matched")
    return e.join(a, list(key), "full").withColumn("differs", differ).withColumn("status", status).drop("_e", "_a")


def precision_recall(compared: DataFrame) -> DataFrame:
    """One row: counts, precision and recall of the identities; 0 where there is nothing to divide by."""
    found = F.count_if(F.col("status").isin("matched", "mismatch"))
    out = compared.agg(found.alias("found"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "unexpected").alias("unexpected"), F.count_if(F.col("status") == "mismatch").alias("mismatched"))
    share = lambda other: F.when(F.col("found") + F.col(other) > 0, F.col("found") / (F.col("found") + F.col(other))).otherwise(0.0)
    return out.withColumn("precision", share("unexpected")).withColumn("recall", share("missing"))


def coverage(discovered: DataFrame, covered: DataFrame, exempt: DataFrame, key: str, least: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """(report, gaps): what of the discovered, non-exempt units is covered."""
    due = discovered.select(key).distinct().join(exempt.select(key), key, "left_anti")
    marked = due.join(covered.select(key).distinct().withColumn("_c", F.lit(1)), key, "left")
    report = marked.agg(F.count(F.lit(1)).alias("units"), F.count("_c").alias("covered"))
    ratio = F.when(F.col("units") > 0, F.col("covered") / F.col("units")).otherwise(0.0)
    return report.withColumn("ratio", ratio).withColumn("passed", F.col("ratio") >= least), marked.where("_c is null").select(key)


def histogram(rows: DataFrame, value: str, by: Sequence[str] = (), buckets: Sequence[float] = BUCKETS) -> DataFrame:
    """(by, le, n, total, sum): cumulative counts per upper bound, in one aggregation."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(buckets)]
    one = rows.groupBy(*by).agg(*counts, F.count(value).alias("total"), F.sum(value).alias("sum"))
    bound = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(buckets)]))
    return one.select(*by, bound.alias("x"), "total", "sum").select(*by, "x.le", "x.n", "total", "sum")


def bucket_quantile(hist: DataFrame, q: float, by: Sequence[str] = ()) -> DataFrame:
    """The quantile by linear interpolation within the bucket that holds it; beyond the last bound, that bound."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("le")
    want = F.col("total") * q
    prior, low = F.coalesce(F.lag("n").over(w), F.lit(0)), F.coalesce(F.lag("le").over(w), F.lit(0.0))
    at = low + (F.col("le") - low) * (want - prior) / (F.col("n") - prior)
    cand = hist.withColumn("_v", F.when((F.col("n") >= want) & (prior < want), at))
    return cand.groupBy(*by).agg(F.coalesce(F.min("_v"), F.max("le")).alias("quantile"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows of each stratum by the hash of seed, stratum and key: the same rows in every run."""
    lot = F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col(stratum), F.col(key).cast("string")), 256)
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("_lot", key))
    return rows.withColumn("_lot", lot).withColumn("sample_rank", place).where(F.col("sample_rank") <= n).drop("_lot")


def counters(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def relation_hash(rows: DataFrame, *cols: str, by: str | None = None) -> DataFrame:
    """One row, or one for each ``by``: a hash of the relation that is the same in any order of rows, and their number.

    Row digests are summed in four lanes, so tasks only send sums: no global sort, no list on the driver.
    """
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cols]), 256)
    lanes = [F.sum(F.conv(F.substring("_d", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"l{i}") for i in range(4)]
    keys = [by] if by else []
    out = rows.select(*keys, digest.alias("_d")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *lanes)
    return out.select(*keys, "n", F.sha2(F.concat_ws(":", "n", *[F.coalesce(F.col(f"l{i}"), F.lit(0)).cast("string") for i in range(4)]), 256).alias("payload_hash"))


def variants(commands: DataFrame) -> DataFrame:
    """Audit of compile commands (root, file, content_hash): units, distinct files and files with several variants by root."""
    varied = F.min("content_hash") != F.max("content_hash")  # more than one; null is none
    per = commands.groupBy("root", "file").agg(F.count(F.lit(1)).alias("n"), varied.alias("varied"))
    return per.groupBy("root").agg(F.sum("n").alias("commands"), F.count(F.lit(1)).alias("files"), F.count_if("varied").alias("varied"))


