"""Embedding of chunks: each distinct text once, cached vectors first, an injected provider for the rest."""

from __future__ import annotations

import math
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH_ITEMS, BATCH_BYTES, BATCH_TOKENS, TRIES, BREAKER = 64, 1 << 20, 32_768, 3, 3


def distinct_contents(chunks: DataFrame) -> DataFrame:
    """(content_hash, text, token_count): one row per content."""
    return chunks.select("content_hash", "text", "token_count").dropDuplicates(["content_hash"])


def cached_vectors(embeddings: DataFrame, provider: str, model: str, dimensions: int) -> DataFrame:
    """The earliest vector of each content for one profile."""
    own = embeddings.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("dimensions") == dimensions))
    first = F.row_number().over(Window.partitionBy("content_hash").orderBy("created_at", "chunk_id"))
    return own.withColumn("_n", first).where("_n = 1").drop("_n")


def batches(rows: list[tuple[str, str, int]]) -> list[list[tuple[str, str, int]]]:
    """Rows (hash, text, tokens) in order, in batches under the limits of items, bytes and tokens."""
    out, size, tokens = [[]], 0, 0
    for row in rows:
        n = len(row[1].encode())
        if out[-1] and (len(out[-1]) >= BATCH_ITEMS or size + n > BATCH_BYTES or tokens + row[2] > BATCH_TOKENS):
            out.append([])
            size = tokens = 0
        out[-1].append(row)
        size, tokens = size + n, tokens + row[2]
    return [b for b in out if b]


def embed(contents: DataFrame, provider: Callable[[list[str], str], list[list[float]]], dimensions: int, wait: float = 0.0) -> DataFrame:
    """(content_hash, embedding) from a provider (texts, idempotency key) -> vectors; a batch keeps its key over retries.

    A provider that fails ``BREAKER`` batches in a row, or answers with the wrong number or shape, fails the task.
    """

    def call(batch):
        key = pd.util.hash_array(pd.Series([b[0] for b in batch]).to_numpy(object)).sum()
        for n in range(TRIES):
            try:
                vectors = provider([b[1] for b in batch], f"{int(key):016x}")
                break
            except ConnectionError:
                if n == TRIES - 1:
                    return None
                time.sleep(wait * 2**n)
        if len(vectors) != len(batch) or any(len(v) != dimensions or not all(map(math.isfinite, v)) for v in vectors):
            raise ValueError("the provider's vectors don't pair off with its texts")
        return pd.DataFrame({"content_hash": [b[0] for b in batch], "embedding": [[float(x) for x in v] for v in vectors]})

    def run(parts):
        failed = 0
        for pdf in parts:
            for batch in batches(list(pdf[["content_hash", "text", "token_count"]].itertuples(index=False, name=None))):
                while (out := call(batch)) is None:
                    failed += 1
                    if failed >= BREAKER:
                        raise ConnectionError("the provider keeps failing")
                failed = 0
                yield out

    return contents.select("content_hash", "text", "token_count").mapInPandas(run, "content_hash string, embedding array<float>")


def embed_chunks(chunks: DataFrame, cache: DataFrame, provider, profile: tuple[str, str, int]) -> DataFrame:
    """``chunks`` with provider, model, dimensions, embedding: from the cache (content_hash, embedding), else the provider."""
    name, model, dimensions = profile
    missing = distinct_contents(chunks).join(cache.select("content_hash"), "content_hash", "left_anti")
    vectors = cache.select("content_hash", "embedding").unionByName(embed(missing, provider, dimensions))
    return chunks.join(vectors, "content_hash").withColumns({"provider": F.lit(name), "model": F.lit(model), "dimensions": F.lit(dimensions)})
