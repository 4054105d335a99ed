"""Hybrid retrieval: the four signals, fused, diversified, reranked and packed, on top of one active generation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.operators import fusion, signals
from lodestone.storage import stash
from lodestone.validate import require


#: How an optional signal may fail: in Spark, at its provider, or for a query that doesn't fit its profile.
SIGNAL_ERRORS = (PySparkException, ConnectionError, TimeoutError, signals.ProfileError)


def result_rules() -> dict[str, Column]:
    """What every hit of a signal must be."""
    return {
        "signal": F.col("source").isin(*schemas.SOURCES), "chunk and file": (F.length("chunk_key") > 0) & (F.length("file_key") > 0), "score": (F.col("score") >= 0) & (F.col("score") < float("inf")) & ~F.isnan("score"),
        "symbol": F.col("symbol_key").isNull() | F.octet_length("symbol_key").between(1, 4096),
    }


def joined_chunks(chunks: DataFrame, symbols: DataFrame, files: DataFrame, repositories: DataFrame, generation_id: str) -> DataFrame:
    """The rows that the signals search: chunks of a generation with their symbol (null: none), file and repository.

    ``chunks``: generation_id, stable_key, symbol_usr, file_id, chunk_kind, text, content_hash; ``symbols``: generation_id,
    stable_usr, qualified_name, name, kind; ``files``: generation_id, file_id, repository_id, path; ``repositories``: id.
    A chunk without its file or repository is not searched.
    """
    own = lambda df: df.where(F.col("generation_id") == generation_id).drop("generation_id")
    named = own(symbols).select("stable_usr", "qualified_name", "name", F.col("kind").alias("symbol_kind"))
    placed = own(files).join(repositories.select(F.col("id").alias("repository_id")), "repository_id", "left_semi").select("file_id", "repository_id", "path")
    return own(chunks).join(placed, "file_id").join(named, F.col("symbol_usr") == F.col("stable_usr"), "left").drop("symbol_usr")


@dataclass(frozen=True)
class Index:
    """The tables of one generation. ``chunks``: stable_key, file_id, stable_usr, qualified_name, name, chunk_kind, text,
    content_hash, repository_id, path; ``postings`` of them; ``edges``; ``embeddings``."""

    chunks: DataFrame
    postings: DataFrame
    edges: DataFrame
    embeddings: DataFrame


@dataclass
class Report:
    hits: DataFrame
    degraded: list[str] = field(default_factory=list)


def retrieve(index: Index, acl: DataFrame, query: str, limit: int = 20, embedding: Sequence[float] | None = None, profile: tuple[str, str, int] | None = None, anchor: str | None = None,
             scores: Callable[[DataFrame], DataFrame] | None = None, budget: int = fusion.BUDGET, per_signal: int | None = None) -> Report:
    """Exact and full text must work; a vector or graph signal that fails is named in ``degraded`` and left out.

    ``scores`` maps ranked rows with text to (chunk_key, score in [0, 1]); then more candidates are ranked first.
    """
    per_signal = signals.bounded(per_signal or max(limit, 50))
    found = [signals.candidates(signals.exact_symbols(index.chunks, acl, query, per_signal), "exact"), signals.candidates(signals.fts_chunks(index.postings, index.chunks, acl, query, per_signal), "fts")]
    degraded = []
    for name, wanted, make in (
        ("vector", embedding is not None, lambda: signals.vector_chunks(index.embeddings, index.chunks, acl, profile, embedding, per_signal)),
        ("graph", anchor is not None, lambda: signals.graph_signals(index.edges, index.chunks, acl, anchor, limit=per_signal)),
    ):
        if not wanted:
            continue
        try:
            found.append(stash(signals.candidates(make(), name), f"signal-{name}"))
        except SIGNAL_ERRORS:  # anything else is an error of the program
            degraded.append(name)
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    rows = require(stash(rows, "candidates"), result_rules())  # a few hundred, all of them before any is ranked
    ranked = fusion.diversify(fusion.rrf(rows, most=signals.MOST), limit=per_signal if scores else limit)
    if scores:
        texts = index.chunks.select(F.col("stable_key").alias("chunk_key"), "text")
        ranked = stash(ranked, "ranked")
        ranked = fusion.rerank(ranked, scores(ranked.join(texts, "chunk_key")))
    full = ranked.join(index.chunks.select(F.col("stable_key").alias("chunk_key"), "text", "path", "chunk_kind", "qualified_name"), "chunk_key")
    return Report(fusion.pack(full, budget, limit), degraded)


#: Limits of a rerank request: rows, bytes of the query, of a text, and of all.
RERANK_ROWS, RERANK_QUERY, RERANK_TEXT, RERANK_BYTES = 100, 16 << 10, 64 << 10, 1 << 20


@dataclass(frozen=True)
class Reranker:
    """A provider: its names, whether it may be used, and ``call`` (query, [(chunk_key, text)], idempotency key) -> {chunk_key: score}."""

    id: str
    model: str
    call: Callable[[str, list[tuple[str, str]], str], dict[str, float]]
    enabled: bool = True
    approved: bool = False
    tries: int = 2


def rerank_scores(ranked: DataFrame, reranker: Reranker, project_id: str, query: str) -> DataFrame:
    """(chunk_key, score) for ranked rows (chunk_key, text) from a provider that is enabled and approved to see the texts.

    A request has bounded rows and bytes, so they go through the driver. Its key is of the query and the contents, and stays
    over the tries; only lost connections are tried again. Scores must pair off with the rows and lie in 0 to 1.
    """
    if not (reranker.enabled and reranker.approved):
        raise PermissionError("the provider is disabled, or not approved to process data")
    rows = [(r["chunk_key"], r["text"]) for r in ranked.select("chunk_key", "text", "rank").orderBy("rank").limit(RERANK_ROWS + 1).collect()]
    sizes = [len((text or "").encode()) for _, text in rows]
    bad = not query.strip() or "\0" in query or len(query.encode()) > RERANK_QUERY or not 1 <= len(rows) <= RERANK_ROWS or len({k for k, _ in rows}) < len(rows)
    if bad or min(sizes) == 0 or max(sizes) > RERANK_TEXT or sum(sizes) + len(query.encode()) > RERANK_BYTES or any("\0" in text for _, text in rows):
        raise ValueError("not a request that a provider may be sent")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    said = {"schema_version": 1, "project_id": project_id, "provider": reranker.id, "model": reranker.model, "query_hash": sha(query), "inputs": [{"chunk_key": k, "content_hash": sha(t)} for k, t in rows]}
    key = sha(json.dumps(said, separators=(",", ":")))
    for n in range(reranker.tries):
        try:
            scores = reranker.call(query, rows, key)
            break
        except (ConnectionError, TimeoutError):
            if n == reranker.tries - 1:
                raise
    if set(scores) != {k for k, _ in rows} or not all(isinstance(x, (int, float)) and 0 <= x <= 1 for x in scores.values()):
        raise ValueError("the provider's scores don't pair off with its texts")
    return ranked.sparkSession.createDataFrame([(k, float(x)) for k, x in scores.items()], "chunk_key string, score double")
