"""An index of vectors in inverted cells: every vector is stored in its nearest cell, and a search reads a few cells only.

The cells' centres are fitted on a sample of ``SAMPLE`` vectors at most (spherical k-means); all rows are stored. What a search
reads is ranked exactly, so its only loss are neighbours in cells that it doesn't probe. How many it probes is what ``TARGET``
of the sample's own neighbours need: few where vectors lie in clusters, most cells where they lie anywhere. ``recall`` measures
it over all rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors as vx
from lodestone.operators.signals import bounded, vector_topk
from lodestone.storage import new_path

#: Vectors that centres are fitted on at most, rounds of fitting, most cells; sampled queries, their neighbours, and the share of these to be found.
SAMPLE, ROUNDS, MOST_CELLS, ASKED, NEIGHBOURS, TARGET = 20_000, 12, 4096, 500, 20, 0.95
#: Rows, and queries, that are compared at once.
ROWS, QUERIES = 4096, 256


def directions(vectors, size: int) -> np.ndarray:
    """Unit vectors of a batch; zeros for what is null, of another dimension, not finite, or of no length."""
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == size:
            out[i] = v
    out[~np.isfinite(out).all(1)] = 0
    length = np.sqrt((out * out).sum(1))
    return out / np.where(length > 0, length, 1)[:, None]


@dataclass(frozen=True)
class Cells:
    """An index: where its rows are, the centres (cells x dimensions), and how many cells a search probes."""

    path: str
    centres: np.ndarray
    probes: int


def sampled(rows: DataFrame, key: str, vector: str = "embedding", sample: int = SAMPLE) -> np.ndarray:
    """Directions of the ``sample`` rows of the smallest hashes, of the dimension that most of them have."""
    few = [r[0] for r in rows.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(sample).select(vector).collect()]
    if not few:
        return np.zeros((0, 0))
    x = directions(few, int(np.bincount([len(v) for v in few]).argmax()))
    return x[x.any(1)]


def fit(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of directions: no more than ``cells``, ``MOST_CELLS`` and rows."""
    wanted = min(cells, MOST_CELLS, len(x))
    if not wanted:
        return np.zeros((0, x.shape[1]))
    deal = np.random.default_rng(17)
    centres = x[deal.choice(len(x), wanted, replace=False)]
    for _ in range(ROUNDS):
        nearest, sums = (x @ centres.T).argmax(1), np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        length = np.sqrt((sums * sums).sum(1))
        centres = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], x[deal.choice(len(x), wanted)])
    return centres


def enough(x: np.ndarray, centres: np.ndarray, target: float = TARGET) -> int:
    """The fewest cells to probe so that ``target`` of the nearest sampled neighbours of sampled queries lie in them."""
    if not len(centres):
        return 1
    cell, asked = (x @ centres.T).argmax(1), x[:ASKED]
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :NEIGHBOURS]
    turn = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # when a query comes to a cell
    needed = np.sort(np.take_along_axis(turn, cell[near], 1).ravel())
    return int(needed[max(0, -(-int(target * 1000) * len(needed) // 1000) - 1)]) + 1


def _cells(centres: np.ndarray, most: int):
    """The ``most`` nearest cells of each vector, nearest first; none for what has no direction."""

    @F.pandas_udf("array<int>")
    def run(vectors: pd.Series) -> pd.Series:
        x = directions(list(vectors), centres.shape[1])
        order = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :most]
        return pd.Series([list(map(int, o)) if v.any() else [] for o, v in zip(order, x)])

    return run


def write_cells(rows: DataFrame, centres: np.ndarray, path: str, key: str, vector: str = "embedding") -> None:
    """Stores ``rows`` by their nearest cell (a folder each); a cell of many rows is cut into several files."""
    placed = rows.withColumn("cell", F.coalesce(F.get(_cells(centres, 1)(vector), F.lit(0)), F.lit(-1)) if len(centres) else F.lit(-1))
    placed.repartitionByRange("cell", key).sortWithinPartitions("cell").write.option("maxRecordsPerFile", 1_000_000).partitionBy("cell").parquet(path)


def search(spark: SparkSession, index: Cells, query: Sequence[float], key: str, limit: int = 20, vector: str = "embedding") -> DataFrame:
    """The nearest ``limit`` rows of the cells probed, as ``vector_topk`` ranks them. Files of other cells aren't opened."""
    vx.checked_query(query)
    q = directions([query], index.centres.shape[1])[0]
    own = [int(c) for c in np.argsort(-(index.centres @ q), kind="stable")[: index.probes]]
    return vector_topk(spark.read.parquet(index.path).where(F.col("cell").isin(own)), query, key, limit, vector)


_PACK = "cell int, keys array<string>, vectors array<array<double>>"


def _packed(size: int, dimensions: int):
    """Rows (cell, key, vector) sorted by cell, as blocks of one cell."""

    def run(batches):
        cell, keys, vectors = None, [], []
        for pdf in batches:
            for c, k, v in zip(pdf["cell"], pdf["key"], directions(list(pdf["vector"]), dimensions)):
                if keys and (c != cell or len(keys) >= size):
                    yield pd.DataFrame({"cell": [cell], "keys": [keys], "vectors": [vectors]})
                    keys, vectors = [], []
                cell = c
                keys.append(k), vectors.append(v)
        if keys:
            yield pd.DataFrame({"cell": [cell], "keys": [keys], "vectors": [vectors]})

    return run


def _best(limit: int):
    """The best rows of a block for each query of another block."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x, q = np.stack(row.vectors), np.stack(row.q_vectors)
                score = q @ x.T
                top = np.argsort(-score, axis=1, kind="stable")[:, :limit] if score.shape[1] > limit else np.tile(np.arange(score.shape[1]), (len(q), 1))
                keys = np.asarray(row.keys, object)
                yield pd.DataFrame({"query": np.repeat(np.asarray(row.q_keys, object), top.shape[1]), "key": keys[top].ravel(), "score": np.take_along_axis(score, top, 1).ravel()})

    return run


def search_many(spark: SparkSession, index: Cells, queries: DataFrame, key: str, limit: int = 20, vector: str = "embedding") -> DataFrame:
    """(query, key, score, rank): the nearest ``limit`` rows of each of ``queries`` (key, vector) among the cells that it probes.

    Queries and rows meet by cell, in blocks of ``QUERIES`` and ``ROWS``: a cell of many rows is many blocks, and only the best
    of each block leave it. Equal scores are ranked by key.
    """
    if not len(index.centres):
        return spark.createDataFrame([], "query string, key string, score double, rank int")
    size, kind = index.centres.shape[1], queries.schema[key].dataType
    told = lambda df, at: df.select(at, F.col(key).cast("string").alias("key"), F.col(vector).alias("vector"))
    rows = told(spark.read.parquet(index.path).where("cell >= 0"), "cell").sortWithinPartitions("cell").mapInPandas(_packed(ROWS, size), _PACK)
    asked = told(queries, F.explode(_cells(index.centres, index.probes)(vector)).alias("cell"))
    asked = asked.repartition("cell").sortWithinPartitions("cell").mapInPandas(_packed(QUERIES, size), _PACK)
    met = rows.join(asked.withColumnsRenamed({"keys": "q_keys", "vectors": "q_vectors"}), "cell").select("keys", "vectors", "q_keys", "q_vectors")
    found = met.mapInPandas(_best(bounded(limit)), "query string, key string, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("key").cast(kind)))
    best = found.withColumn("rank", rank).where(F.col("rank") <= limit)
    return best.select(F.col("query").cast(kind).alias("query"), F.col("key").cast(kind).alias("key"), F.greatest(F.lit(0.0), F.col("score")).alias("score"), "rank")


def build(rows: DataFrame, key: str, vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> Cells:
    """An index of ``rows`` in the shared folder, of as many cells as the root of all rows by default.

    Rows whose vector is null, of another dimension, not finite or of no length are stored, but in no cell that is probed.
    """
    x, path = sampled(rows, key, vector, sample), new_path(rows.sparkSession, "cells")
    centres = fit(x, cells or round(rows.count() ** 0.5))
    write_cells(rows.select(key, vector), centres, path, key, vector)
    return Cells(path, centres, enough(x, centres))


def recall(spark: SparkSession, index: Cells, queries: DataFrame, key: str, limit: int = 20, vector: str = "embedding") -> DataFrame:
    """One row (queries, cells, probed, recall, share_read) of some queries, held against a search that probes every cell."""
    got = search_many(spark, index, queries, key, limit, vector).select("query", "key", F.lit(1).alias("hit"))
    want = search_many(spark, replace(index, probes=len(index.centres)), queries, key, limit, vector).select("query", "key")
    found = want.join(got, ["query", "key"], "left").agg(F.count_distinct("query").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    sizes = spark.read.parquet(index.path).where("cell >= 0").groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    probed = queries.select(F.explode(_cells(index.centres, index.probes)(vector)).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("times"))
    read = sizes.join(probed, "cell", "left").agg((F.sum(F.col("n") * F.coalesce("times", F.lit(0))) / F.sum("n")).alias("read"))
    return found.crossJoin(read).select("queries", F.lit(len(index.centres)).alias("cells"), F.lit(index.probes).alias("probed"), "recall", (F.col("read") / F.col("queries")).alias("share_read"))
