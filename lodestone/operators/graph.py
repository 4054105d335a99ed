"""Relations: merging of extracted edges, ownership, bounded traversal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.storage import stash
from lodestone.validate import require

EDGE_KEY = ["edge_type", "src_usr", "dst_usr", "file", "line", "column"]


def merge_edges(shards: DataFrame, keys: list[str] = EDGE_KEY) -> DataFrame:
    """One edge per key (null parts are equal) with the largest confidence; partial maxima are taken before the shuffle."""
    return shards.groupBy(*keys).agg(F.max("confidence").alias("confidence"))


def checked_edges(edges: DataFrame) -> DataFrame:
    return require(edges, {
        "edge type": F.col("edge_type").isin(*schemas.EXTRACTED_EDGE_TYPES), "confidence": F.col("confidence").between(0, 1),
        "ends": (F.length("src_usr") > 0) & (F.length("dst_usr") > 0), "place": F.col("line").isNull() | (F.col("line") >= 1),
    })


def in_order(edges: DataFrame, locale: str | None = None) -> DataFrame:
    """Edges in their total order: type, ends, then place, without a place first; by code point, or a ``locale`` (UNICODE: the root one)."""
    text = (lambda c: F.collate(F.col(c).cast("string"), locale)) if locale else F.col
    return edges.orderBy(text("edge_type"), text("src_usr"), text("dst_usr"), *[F.asc_nulls_first(c) for c in ("file", "line", "column") if c in edges.columns], F.desc("confidence"))


def merge_includes(shards: DataFrame) -> DataFrame:
    return shards.select("src_file", "dst_file", "line", "column").distinct()


def owns_edges(symbols: DataFrame) -> DataFrame:
    """owner -> symbol, for owners that are symbols themselves."""
    owned = symbols.where("owner_usr is not null").select(F.col("owner_usr").alias("src_usr"), F.col("stable_usr").alias("dst_usr"))
    known = symbols.select(F.col("stable_usr").alias("src_usr"))
    null = lambda t: F.lit(None).cast(t)
    return owned.join(known, "src_usr", "left_semi").select(F.lit("owns").alias("edge_type"), "src_usr", "dst_usr", null("string").alias("file"), null("int").alias("line"), null("int").alias("column"), F.lit(1.0).alias("confidence"))


def relation_index(shards: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, counts): merged edges whose both ends are symbols, with ownership; counts has what was merged or left out."""
    merged = stash(merge_edges(checked_edges(shards)), "edges")
    ends = symbols.select("stable_usr")
    kept = merged.join(ends.withColumnRenamed("stable_usr", "src_usr"), "src_usr", "left_semi").join(ends.withColumnRenamed("stable_usr", "dst_usr"), "dst_usr", "left_semi")
    owns = owns_edges(symbols)
    edges = stash(kept.select(*EDGE_KEY, "confidence").unionByName(owns), "relations")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = count(shards, "source_edges").crossJoin(count(merged, "merged_edges")).crossJoin(edges.agg(F.count_if(F.col("edge_type") != "owns").alias("resolved_edges"), F.count_if(F.col("edge_type") == "owns").alias("owns_edges")))
    counts = counts.crossJoin(count(symbols.where("owner_usr is not null"), "owned"))  # each is one row
    return edges, counts.select("source_edges", (F.col("source_edges") - F.col("merged_edges")).alias("deduplicated"), (F.col("merged_edges") - F.col("resolved_edges")).alias("unresolved"), "owns_edges", (F.col("owned") - F.col("owns_edges")).alias("unresolved_owners"))


def bfs(edges: DataFrame, starts: DataFrame, depth: int, src: str = "src", dst: str = "dst", direction: str = "out", most_nodes: int | None = None) -> DataFrame:
    """(node, depth): what ``starts`` (node) reach in at most ``depth`` steps, each at its least depth, starts at 0.

    A level is one join and one anti-join with what is known; each is written to the shared folder, which cuts the
    lineage. With ``most_nodes``, a level is cut to the room that is left, by node.
    """
    if not 1 <= depth <= 16:
        raise ValueError("a depth of 1 to 16")
    step = {"out": [(src, dst)], "in": [(dst, src)], "both": [(src, dst), (dst, src)]}[direction]
    hops = None
    for a, b in step:
        one = edges.select(F.col(a).alias("node"), F.col(b).alias("next"))
        hops = one if hops is None else hops.unionByName(one)
    hops = stash(hops.distinct(), "hops")
    seen = stash(starts.select("node").distinct().withColumn("depth", F.lit(0)), "reached")
    level, total = seen, seen.count()
    for d in range(1, depth + 1):
        fresh = level.select("node").join(hops, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        if most_nodes is not None:
            fresh = fresh.orderBy("node").limit(max(0, most_nodes - total))
        level = stash(fresh.withColumn("depth", F.lit(d)), "level")
        n = level.count()
        if not n:
            break
        seen, total = seen.unionByName(level), total + n
    return seen


def trace_calls(edges: DataFrame, symbol: str, depth: int = 3, nodes: int = 100, direction: str = "out") -> DataFrame:
    """Contract only: callees or callers of a symbol, at most ``nodes`` besides it."""
    if not (1 <= depth <= 8 and 1 <= nodes <= 500):
        raise ValueError("a depth of 1 to 8 and 1 to 500 nodes")
    start = edges.sparkSession.createDataFrame([(symbol,)], "node string")
    return bfs(edges.where("edge_type = 'calls'"), start, depth, "src_usr", "dst_usr", direction, nodes + 1)


def derived_types(edges: DataFrame, symbol: str, depth: int = 8) -> DataFrame:
    """Contract only: the types below ``symbol`` in the inheritance tree."""
    return bfs(edges.where("edge_type = 'inherits'"), edges.sparkSession.createDataFrame([(symbol,)], "node string"), depth, "src_usr", "dst_usr", "in")


def module_dependencies(edges: DataFrame, module: str, depth: int = 3) -> DataFrame:
    """Contract only: the modules that ``module`` depends on (src, dst)."""
    if not 1 <= depth <= 8:
        raise ValueError("a depth of 1 to 8")
    return bfs(edges, edges.sparkSession.createDataFrame([(module,)], "node string"), depth)
