"""Weighted reciprocal-rank fusion, diversity, reranking and packing, for one query or many (``by`` names the query)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.storage import stash
from lodestone.validate import ValidationError

#: The default weight of each signal, the rank constant, and the caps of the diversity pass.
WEIGHTS, RANK_CONSTANT = {"exact": 1.0, "fts": 0.8, "vector": 0.7, "graph": 0.5}, 60
PER_SYMBOL, PER_FILE, LIMIT = 3, 5, 20
RERANK_WEIGHT, BUDGET = 0.7, 1 << 20
#: Rows of a query that a round of packing looks at.
AT_ONCE = 500


def identity_conflicts(candidates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Chunks that candidates describe in more than one way."""
    what = F.struct("file_key", F.coalesce("symbol_key", F.lit("\0none")))
    return candidates.groupBy(*by, "chunk_key").agg(F.count_distinct(what).alias("n")).where("n > 1")


def rrf(candidates: DataFrame, weights: dict[str, float] = WEIGHTS, k: int = RANK_CONSTANT, by: Sequence[str] = (), pin_exact: bool = True, check: bool = True, most: int | None = None) -> DataFrame:
    """(by, chunk_key, symbol_key, file_key, fusion_score, evidence, top_exact, rank) from (by, source, chunk_key, ..., score).

    A query's candidates are ranked together: ``most`` says how many a source may give for it, and raises for more.

    A source counts a chunk once, at its best score. Scores are added in the order of the sources, so that sums agree
    to the bit. Chunks without weight are dropped; the best exact match leads, unless ``pin_exact`` is false.
    """
    if check and not identity_conflicts(candidates, by).isEmpty():
        raise ValidationError("conflicting chunk identity")
    if most is not None and not candidates.groupBy(*by, "source").count().where(F.col("count") > most).isEmpty():
        raise ValidationError(f"more than {most} candidates of a source")
    best = candidates.groupBy(*by, "source", "chunk_key").agg(F.max("score").alias("score"), F.min("symbol_key").alias("symbol_key"), F.min("file_key").alias("file_key"))
    place = F.row_number().over(Window.partitionBy(*by, "source").orderBy(F.desc("score"), "chunk_key"))
    weight = F.coalesce(*[F.when(F.col("source") == s, F.lit(float(w))) for s, w in weights.items()], F.lit(0.0))
    ranked = best.withColumn("source_rank", place).withColumn("part", weight / (k + F.col("source_rank")))
    order = F.array_position(F.array(*map(F.lit, schemas.SOURCES)), F.col("source"))
    proof = F.struct(order.alias("ord"), "source", "source_rank", F.col("score").alias("source_score"), F.col("part").alias("weighted_rrf_score"))
    parts = [F.max(F.when(F.col("source") == s, F.col("part"))).alias(f"p_{s}") for s in schemas.SOURCES]
    fused = ranked.groupBy(*by, "chunk_key").agg(
        F.min("symbol_key").alias("symbol_key"), F.min("file_key").alias("file_key"), *parts, F.array_sort(F.collect_list(proof)).alias("evidence"),
        F.coalesce(F.max((F.col("source") == "exact") & (F.col("source_rank") == 1)), F.lit(False)).alias("top_exact"),
    )
    total: Column = F.lit(0.0)
    for s in schemas.SOURCES:
        total = total + F.coalesce(F.col(f"p_{s}"), F.lit(0.0))
    evidence = F.transform("evidence", lambda e: F.struct(e["source"].alias("source"), e["source_rank"].alias("source_rank"), e["source_score"].alias("source_score"), e["weighted_rrf_score"].alias("weighted_rrf_score")))
    fused = fused.withColumn("fusion_score", total).where("fusion_score > 0").withColumn("evidence", evidence)
    first = [F.desc("top_exact")] if pin_exact else []
    fused = fused.withColumn("rank", F.row_number().over(_all(by).orderBy(*first, F.desc("fusion_score"), "chunk_key")))
    return fused.select(*by, "chunk_key", "symbol_key", "file_key", "fusion_score", "evidence", "top_exact", "rank")


def _all(by: Sequence[str]):
    """One window per query: its rows are the candidates of one query, which signals limit to a few hundred."""
    return Window.partitionBy(*(by or [F.lit(0)]))


def _per_query(rows: DataFrame, by: Sequence[str], run) -> DataFrame:
    if by:
        return rows.groupBy(*by).applyInPandas(run, rows.schema)
    return rows.withColumn("_query", F.lit(0)).groupBy("_query").applyInPandas(lambda pdf: run(pdf.drop(columns="_query")), rows.schema)


def diversify(ranked: DataFrame, per_symbol: int = PER_SYMBOL, per_file: int = PER_FILE, limit: int = LIMIT, by: Sequence[str] = ()) -> DataFrame:
    """Takes rows in rank order while their symbol (null: no cap) and file have room; a skipped row uses up no room.

    Of rows of one symbol and file no more than the lesser cap are taken, and the first of them are; without a symbol cap
    that binds, the first of each file. Only these go to the group of a query, so its size follows the symbols and files.
    """
    least = F.when(F.col("symbol_key").isNull(), F.lit(per_file)).otherwise(F.lit(min(per_symbol, per_file)))
    like = F.row_number().over(Window.partitionBy(*by, "symbol_key", "file_key").orderBy("rank"))
    ranked_cols = ranked.columns
    if per_symbol >= per_file and per_symbol >= limit:
        # one cap: the rows are the first of each file, and no pass over a query is needed
        kept = ranked.withColumn("_like", F.row_number().over(Window.partitionBy(*by, "file_key").orderBy("rank"))).where(F.col("_like") <= per_file).drop("_like")
        return kept.withColumn("rank", F.row_number().over(_all(by).orderBy("rank"))).where(F.col("rank") <= limit).select(*ranked_cols)
    ranked = ranked.withColumn("_like", like).where(F.col("_like") <= least).select(*ranked_cols)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        symbols, files, taken = {}, {}, []
        for i, (s, f) in enumerate(zip((pdf := pdf.sort_values("rank"))["symbol_key"], pdf["file_key"])):
            if (s is not None and symbols.get(s, 0) >= per_symbol) or files.get(f, 0) >= per_file:
                continue
            symbols[s], files[f] = symbols.get(s, 0) + 1, files.get(f, 0) + 1
            taken.append(i)
            if len(taken) == limit:
                break
        return pdf.iloc[taken].assign(rank=range(1, len(taken) + 1))

    return _per_query(ranked, by, run)


def rerank(ranked: DataFrame, scores: DataFrame, weight: float = RERANK_WEIGHT, by: Sequence[str] = (), pin_exact: bool = True) -> DataFrame:
    """Fuses the prior rank with that of external scores (by, chunk_key, score in [0, 1]), which must pair off with the rows."""
    if not 0 <= weight <= 1:
        raise ValueError("a weight of 0 to 1")
    joined = ranked.join(scores.select(*by, "chunk_key", F.col("score").alias("rerank_score"), F.lit(True).alias("_scored")), [*by, "chunk_key"], "full")
    bad = joined.where(F.col("rank").isNull() | F.col("_scored").isNull() | ~F.coalesce(F.col("rerank_score").between(0, 1), F.lit(False)))
    if not bad.isEmpty():
        raise ValidationError("scores don't pair off with candidates")
    out = joined.drop("_scored").withColumn("rerank_rank", F.row_number().over(_all(by).orderBy(F.desc("rerank_score"), "chunk_key")))
    out = out.withColumnRenamed("rank", "pre_rerank_rank").withColumn("rerank_fusion_score", (1 - weight) / F.col("pre_rerank_rank") + weight / F.col("rerank_rank"))
    first = [F.desc("top_exact")] if pin_exact else []
    return out.withColumn("rank", F.row_number().over(_all(by).orderBy(*first, F.desc("rerank_fusion_score"), "chunk_key")))


def pack(ranked: DataFrame, budget: int = BUDGET, limit: int = LIMIT, by: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Takes rows in rank order while their UTF-8 text fits what is left of ``budget``; one that doesn't fit is skipped."""
    sized = ranked.withColumn("utf8_bytes", F.octet_length(text).cast("long"))
    taken = packed(sized, budget, limit, by).drop("utf8_bytes").select("chunk_key", F.col("rank").alias("_place"), F.col("before").alias("_rank"), *[F.col(c).alias(f"_by_{c}") for c in by])
    same = (sized["chunk_key"] == taken["chunk_key"]) & (sized["rank"] == taken["_rank"])
    for c in by:
        same &= sized[c].eqNullSafe(taken[f"_by_{c}"])
    place = F.col("_place").cast(sized.schema["rank"].dataType).alias("rank")
    return sized.join(taken, same).select(*[place if c == "rank" else sized[c] for c in sized.columns])


def packed(sized: DataFrame, budget: int = BUDGET, limit: int = LIMIT, by: Sequence[str] = (), at_once: int = AT_ONCE) -> DataFrame:
    """What ``pack`` takes, from (by, chunk_key, rank, utf8_bytes) alone: these, rank anew, and ``before``: the rank it had.

    No task holds all rows of a query. A round takes from the first ``at_once`` rows that fit what is left by themselves;
    so the first of them is always taken, and there are ``limit`` rounds at most, as a rule one or two.
    """
    if not 1 << 10 <= budget <= 4 << 20:
        raise ValueError("a budget of 1 KiB to 4 MiB")
    keys = [f"k{i}" for i in range(len(by))] or ["k"]
    named = [F.col(c).alias(k) for c, k in zip(by, keys)] or [F.lit(0).alias("k")]
    rows = stash(sized.select(*named, "chunk_key", F.col("rank").cast("long").alias("before"), "utf8_bytes").where(F.col("utf8_bytes") <= budget), "sizes")
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + ", chunk_key string, before long, utf8_bytes long, rank long, left long, more boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("before", kind="stable")
        left, n, taken, places = int(pdf["left"].iloc[0]), int(pdf["n"].iloc[0]), [], []
        for i, size in enumerate(pdf["utf8_bytes"]):
            if size <= left and n < limit:
                left, n = left - int(size), n + 1
                taken.append(i)
                places.append(n)
        out = pdf.iloc[taken].assign(rank=places, left=left, more=False)
        # the state after these rows: how many are taken, up to which rank, what is left
        state = pdf.iloc[-1:].assign(chunk_key=None, utf8_bytes=0, rank=n, left=left, more=len(pdf) >= at_once and n < limit)
        return pd.concat([out, state])[[*keys, "chunk_key", "before", "utf8_bytes", "rank", "left", "more"]]

    first = F.rank().over(Window.partitionBy(*keys).orderBy("before"))
    now, done = rows.withColumns({"left": F.lit(budget).cast("long"), "n": F.lit(0).cast("long")}), None
    while True:
        out = stash(now.withColumn("first", first).where(F.col("first") <= at_once).drop("first").groupBy(*keys).applyInPandas(run, kinds), "packed")
        new = out.where("chunk_key is not null")
        done = new if done is None else done.unionByName(new)
        state = out.where("more").select(*[F.col(k).alias(f"s_{k}") for k in keys], F.col("before").alias("upto"), "left", F.col("rank").alias("n"))
        if state.isEmpty():
            break
        same = (rows["before"] > state["upto"]) & (rows["utf8_bytes"] <= state["left"])
        for k in keys:
            same &= rows[k].eqNullSafe(state[f"s_{k}"])
        now = rows.join(state, same).select(*[rows[c] for c in rows.columns], "left", "n")
    return done.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "chunk_key", "utf8_bytes", "before", "rank")
