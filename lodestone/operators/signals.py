"""The four retrieval signals. Each filters by scope and access before it ranks, and ranks in a total order."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import schemas
from lodestone.functions import text as tx
from lodestone.functions import vectors as vx
from lodestone.operators.acl import visible

MOST = 100


class ProfileError(ValueError):
    """A query vector that isn't of the profile's dimension."""


def bounded(limit: int, most: int = MOST) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"a limit of 1 to {most}")
    return limit


def active_scope(generations: DataFrame, projects: DataFrame, project_id: str, generation_id: str) -> str:
    """The generation's id if it and its project are active; else an error: no scope never means every scope."""
    ok = generations.where((F.col("id") == generation_id) & (F.col("project_id") == project_id) & (F.col("status") == "active"))
    if ok.join(projects.where("status = 'active'").select(F.col("id").alias("project_id")), "project_id", "left_semi").isEmpty():
        raise LookupError("scope-not-active")
    return generation_id


def exact_score(query: str, usr: str = "stable_usr", qualified: str = "qualified_name", name: str = "name") -> Column:
    """1 for the identity, 0.95 for a name, else null."""
    return F.when(F.col(usr) == query, 1.0).when((F.col(qualified) == query) | (F.col(name) == query), 0.95)


def exact_symbols(chunks: DataFrame, acl: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Chunks (joined with symbol and file) whose symbol is ``query``: definitions first, then declarations, then others."""
    query = tx.normalised(query, 4096)
    kind = F.when(F.col("chunk_kind") == "definition", 0).when(F.col("chunk_kind") == "declaration", 1).otherwise(2)
    hits = visible(chunks.withColumn("score", exact_score(query)).where("score is not null"), acl)
    return hits.orderBy(F.desc("score"), kind, "qualified_name", "stable_key").limit(bounded(limit))


def postings(chunks: DataFrame, key: str = "stable_key", text: str = "text", only: Sequence[str] | None = None) -> DataFrame:
    """The inverted index: (token, key, positions); for ``only`` some tokens, where texts are searched without an index.

    For repeated use, ``write_postings`` stores it so that a query reads the files of its own tokens alone.
    """
    words = chunks.select(key, F.posexplode(tx.terms(F.col(text))).alias("pos", "token"))
    if only is not None:
        words = words.where(F.col("token").isin(list(only)))
    return words.groupBy("token", key).agg(F.sort_array(F.collect_list("pos")).alias("positions"))


#: Folders that stored postings are dealt to, by hash of the token.
SHELVES = 256


def write_postings(index: DataFrame, path: str, shelves: int = SHELVES) -> None:
    """Stores postings by a hash of the token, sorted by token within it: frequent tokens are cut into several files."""
    shelf = F.pmod(F.xxhash64("token"), F.lit(shelves)).cast("int")
    dealt = index.withColumn("shelf", shelf).repartitionByRange("shelf", "token", *[c for c in index.columns if c not in ("token", "positions")])
    dealt.sortWithinPartitions("shelf", "token").write.partitionBy("shelf").option("maxRecordsPerFile", 5_000_000).parquet(path)


def read_postings(spark, path: str, query: str, shelves: int = SHELVES) -> DataFrame:
    """The stored postings of the terms of ``query``: of their shelves only, by the statistics of their files."""
    words = sorted(set(query_terms(query)))
    own = sorted({r[0] for r in spark.createDataFrame([(w,) for w in words], "token string").select(F.pmod(F.xxhash64("token"), F.lit(shelves))).collect()})
    return spark.read.parquet(path).where(F.col("shelf").isin(own) & F.col("token").isin(words)).drop("shelf")


@F.pandas_udf(T.DoubleType())
def cover_density(lists: pd.Series) -> pd.Series:
    """Sum of 1 / length over the shortest spans that hold every term (after Clarke, Cormack and Tudhope)."""

    def one(rows) -> float:
        places = sorted((int(p), t) for t, row in enumerate(rows) for p in row)
        last, total, before = [-1] * len(rows), 0.0, -1
        for p, t in places:
            last[t] = p
            begin = min(last)
            if begin > before:  # a span that ends here and holds no other
                total += 1.0 / (p - begin + 1)
                before = begin
        return total

    return lists.map(one)


def cover_scores(postings: DataFrame, words: list[str], key: str) -> DataFrame:
    """(key, score) of the documents that hold all ``words``, from their postings: windows over a document's places, no Python.

    At each place stands, for each word, its last place so far; the earliest of these begins the span that ends here. It
    counts if it begins later than the one before.
    """
    places = postings.select(key, "token", F.explode("positions").alias("at"))
    until = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.max(F.when(F.col("token") == w, F.col("at"))).over(until) for w in words]
    all_there = last[0].isNotNull()
    for x in last[1:]:
        all_there = all_there & x.isNotNull()
    begin = F.when(all_there, F.least(*last) if len(last) > 1 else last[0])
    spans = places.withColumn("begin", begin).withColumn("before", F.lag("begin").over(Window.partitionBy(key).orderBy("at")))
    spans = spans.where(F.col("begin").isNotNull() & (F.col("before").isNull() | (F.col("begin") > F.col("before"))))
    return spans.groupBy(key).agg(F.sum(1.0 / (F.col("at") - F.col("begin") + 1)).alias("score"))


def fts_match(index: DataFrame, query: str, key: str = "stable_key") -> DataFrame:
    """(key, lists): the chunks that hold all terms of ``query``, with the positions of each."""
    words = sorted(set(query_terms(query)))
    if not words:
        return index.select(key, F.array(F.col("positions")).alias("lists")).limit(0)
    hits = index.where(F.col("token").isin(words)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("token", "positions"))).alias("t"))
    return hits.where(F.size("t") == len(words)).select(key, F.transform("t", lambda x: x["positions"]).alias("lists"))


def query_terms(query: str) -> list[str]:
    """The terms of a query, split as the index splits texts."""
    return regex.findall(tx.TERM, tx.normalised(query, 1024).lower())


def fts_chunks(index: DataFrame, chunks: DataFrame, acl: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Chunks that hold all terms of ``query``, by cover density."""
    words = sorted(set(query_terms(query)))
    own = index.where(F.col("token").isin(words))
    hits = cover_scores(own, words, "stable_key") if words else own.select("stable_key", F.lit(0.0).alias("score")).limit(0)
    return visible(chunks.join(hits, "stable_key"), acl).orderBy(F.desc("score"), "stable_key").limit(bounded(limit))


def vector_scores(rows: DataFrame, query: Sequence[float], vector: str = "embedding") -> DataFrame:
    """``rows`` of the query's dimension with score: the cosine, not below 0. Zero vectors have no direction and are left out."""
    vx.checked_query(query)
    q = np.asarray(query, float)
    q = q / np.sqrt(q @ q)

    @F.pandas_udf(T.DoubleType())
    def cosine(vectors: pd.Series) -> pd.Series:
        """A batch of vectors at once; null for a null one, one of another dimension, with a null in it, or of no length."""
        mine = np.array([v is not None and len(v) == len(q) for v in vectors], bool)
        out = np.full(len(vectors), np.nan)
        if mine.any():
            x = np.concatenate(list(vectors[mine])).astype(float).reshape(-1, len(q))
            size = np.sqrt((x * x).sum(1))
            out[mine] = np.where(size > 0, x @ q / np.where(size > 0, size, 1), np.nan)
        return pd.Series(out)

    own = rows.withColumn("distance", 1 - cosine(vector)).where("distance is not null and not isnan(distance)")
    return own.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("distance")))


@F.pandas_udf(T.DoubleType())
def _cosine_of(vectors: pd.Series, others: pd.Series) -> pd.Series:
    """The cosine of two vectors of a row; null where one is null, holds a null, has no length, or their dimensions differ."""

    def matrix(side: pd.Series) -> np.ndarray:
        return np.concatenate(list(side)).astype(float).reshape(len(side), -1)

    sizes = [np.array([-1 if v is None else len(v) for v in side], int) for side in (vectors, others)]
    out = np.full(len(vectors), np.nan)
    for n in set(sizes[0][(sizes[0] == sizes[1]) & (sizes[0] > 0)]):
        at = np.nonzero((sizes[0] == n) & (sizes[1] == n))[0]
        x, y = matrix(vectors.iloc[at]), matrix(others.iloc[at])
        both = np.sqrt((x * x).sum(1) * (y * y).sum(1))
        out[at] = np.where(both > 0, (x * y).sum(1) / np.where(both > 0, both, 1), np.nan)
    return pd.Series(out)


def vector_topk_of(rows: DataFrame, query: DataFrame, key: str, limit: int = 20, vector: str = "embedding") -> DataFrame:
    """The nearest ``limit`` rows to the vector of the only row of ``query``, with score and the query's other columns.

    The query stays a relation, for instance a stored vector picked by its key, and never comes to the driver. Its one row is
    broadcast; more or fewer rows raise. Columns of ``query`` that are named as one of ``rows`` are left out.
    """
    if query.limit(2).count() != 1:
        raise ValueError("a query is one row")
    asked = query.select(F.col(vector).alias("_query"), *[c for c in query.columns if c not in rows.columns and c not in ("distance", "score")])
    both = rows.crossJoin(F.broadcast(asked)).withColumn("distance", 1 - _cosine_of(vector, "_query")).where("distance is not null and not isnan(distance)")
    return both.withColumn("score", F.greatest(F.lit(0.0), 1 - F.col("distance"))).drop("_query").orderBy("distance", key).limit(bounded(limit))


def vector_topk(rows: DataFrame, query: Sequence[float], key: str, limit: int = 20, vector: str = "embedding") -> DataFrame:
    """The exact nearest ``limit`` rows: each task keeps its best, so no shuffle of the table."""
    return vector_scores(rows, query, vector).orderBy("distance", key).limit(bounded(limit))


def vector_chunks(embeddings: DataFrame, chunks: DataFrame, acl: DataFrame, profile: tuple[str, str, int], query: Sequence[float], limit: int = 20) -> DataFrame:
    """Nearest visible chunks among the vectors of one (provider, model, dimensions)."""
    provider, model, dimensions = profile
    if len(query) != dimensions:
        raise ProfileError("the query's dimension isn't the profile's")
    own = embeddings.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("dimensions") == dimensions)).select("content_hash", "embedding")
    return vector_topk(visible(chunks.join(own, "content_hash"), acl), query, "stable_key", limit)


def one_hop(edges: DataFrame, anchor, src: str = "src_usr", dst: str = "dst_usr", types: Sequence[str] | None = None, direction: str = "both", type_col: str = "edge_type") -> DataFrame:
    """Edges at ``anchor`` with ``neighbour``. Both directions are two equi-filters; a loop comes once."""
    if types is not None:
        edges = edges.where(F.col(type_col).isin(list(types)))
    out = edges.where(F.col(src) == anchor).withColumn("neighbour", F.col(dst))
    into = edges.where(F.col(dst) == anchor).withColumn("neighbour", F.col(src))
    if direction == "out":
        return out
    if direction == "in":
        return into
    if direction != "both":
        raise ValueError("out, in or both")
    return out.unionByName(into.where(F.col(src) != F.col(dst)))


def graph_signals(edges: DataFrame, chunks: DataFrame, acl: DataFrame, anchor: str, types: Sequence[str] = schemas.SYMBOL_EDGE_TYPES, direction: str = "both", limit: int = 20) -> DataFrame:
    """Visible chunks of the neighbours of a visible anchor, by confidence. Edges to one chunk each take a place.

    ``edges`` carry the repository and path of their evidence (null: none); evidence must be visible too.
    """
    seen = visible(chunks, acl)
    if seen.where(F.col("stable_usr") == anchor).isEmpty():
        return seen.withColumns({"score": F.lit(None).cast("double"), "edge_type": F.lit(None).cast("string")}).limit(0)
    near = visible(one_hop(edges, anchor, types=types, direction=direction), acl, "evidence_repository_id", "evidence_path", optional=True)
    hits = near.select("neighbour", "edge_type", F.col("confidence").alias("score")).join(seen, F.col("neighbour") == F.col("stable_usr"))
    return hits.drop("neighbour").orderBy(F.desc("score"), "qualified_name", "stable_key", "edge_type").limit(bounded(limit))


def top_per(left: DataFrame, right: DataFrame, on: tuple[str, str], order: Sequence[Column], n: int, sentinel: bool = True) -> DataFrame:
    """Each row of ``left`` with the first ``n`` rows of ``right`` whose key is its own; ``sentinel``: with nulls where there are none.

    A lateral join with a limit, as one window over ``right`` and one join on equality.
    """
    place = F.row_number().over(Window.partitionBy(on[1]).orderBy(*order))
    best = right.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
    return left.join(best, left[on[0]] == best[on[1]], "left" if sentinel else "inner").drop(best[on[1]])


def json_at(column: str, path: str, kind: str = "string") -> Column:
    """What stands at ``path`` of a column of JSON text, as ``kind``; null where there is no such thing."""
    return F.get_json_object(column, path).cast(kind)


def candidates(hits: DataFrame, source: str) -> DataFrame:
    """Hits of one signal in the form that fusion takes."""
    return hits.select(F.lit(source).alias("source"), F.col("stable_key").alias("chunk_key"), F.col("file_id").alias("file_key"), F.col("score").cast("double").alias("score"), F.col("stable_usr").alias("symbol_key"))
