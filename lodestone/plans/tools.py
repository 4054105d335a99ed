"""The read-only tools over a generation: point lookups, excerpts, listings, and signed pages of a result."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import line_slice
from lodestone.operators.acl import visible
from lodestone.operators.signals import bounded, one_hop


def get_symbol(symbols: DataFrame, acl: DataFrame, usr: str) -> DataFrame:
    """Contract only: one visible symbol."""
    return visible(symbols.where(F.col("stable_usr") == usr), acl).limit(1)


def read_file_excerpt(files: DataFrame, acl: DataFrame, repository: str, path: str, first: int, last: int) -> DataFrame:
    """Contract only: at most 500 lines of a visible file."""
    own = files.where((F.col("repository_id") == repository) & (F.col("path") == path))
    return visible(own, acl).select("path", line_slice(F.col("text"), first, last).alias("excerpt"))


def list_projects(projects: DataFrame, roles: DataFrame, limit: int = 50) -> DataFrame:
    """Contract only: the active projects that roles (project_id, role) open."""
    return projects.where("status = 'active'").join(roles.where("role <> 'none'").select(F.col("project_id").alias("id")), "id", "left_semi").orderBy("name", "id").limit(bounded(limit))


def index_status(generations: DataFrame, failures: DataFrame, project: str) -> DataFrame:
    """Contract only: a project's active generation and how many failures it has left open."""
    own = generations.where((F.col("project_id") == project) & (F.col("status") == "active"))
    open_ = failures.where("resolved_at is null").groupBy(F.col("generation_id").alias("id")).agg(F.count(F.lit(1)).alias("open_failures"))
    return own.join(open_, "id", "left").select("id", "status", "published_at", F.coalesce("open_failures", F.lit(0)).alias("open_failures"))


def find_references(edges: DataFrame, usr: str, types=None, direction: str = "in", limit: int = 50) -> DataFrame:
    """Contract only: edges at a symbol, in a total order."""
    return one_hop(edges, usr, types=types, direction=direction).orderBy(F.desc("confidence"), "edge_type", "src_usr", "dst_usr", F.asc_nulls_first("file"), F.asc_nulls_first("line")).limit(bounded(limit))


def narrowed(chunks: DataFrame, repositories=None, kinds=None, module: str | None = None, revision: str | None = None) -> DataFrame:
    """The filters of the code search tool, applied before any signal ranks."""
    cond: Column = F.lit(True)
    if repositories:
        cond = cond & F.col("repository_id").isin(list(repositories))
    if kinds:
        cond = cond & F.col("chunk_kind").isin(list(kinds))
    if module:
        cond = cond & (F.col("module") == module)
    if revision:
        cond = cond & (F.col("revision") == revision)
    return chunks.where(cond)


def keyset_page(rows: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next ``size`` rows after ``after`` (None: the first ones) in the order of ``key``."""
    later = rows if after is None else rows.where(F.col(key) > after)
    return later.orderBy(key).limit(bounded(size))


class Cursor:
    """Signed positions, bound to a tool, a principal and a request, that end after ``ttl`` seconds (at most 900)."""

    def __init__(self, secret: bytes, ttl: int = 300):
        if len(secret) < 32 or not 0 < ttl <= 900:
            raise ValueError("a secret of 32 bytes and at most 900 seconds")
        self.secret, self.ttl = secret, ttl

    def _mac(self, body: bytes) -> bytes:
        return hmac.new(self.secret, body, hashlib.sha256).digest()

    def encode(self, position, tool: str, principal: str, request: str, now: float) -> str:
        body = json.dumps([position, tool, principal, request, now + self.ttl], separators=(",", ":")).encode()
        return base64.urlsafe_b64encode(self._mac(body) + body).decode().rstrip("=")

    def decode(self, token: str, tool: str, principal: str, request: str, now: float):
        try:
            raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
        except ValueError:
            raise ValueError("invalid cursor") from None
        if not hmac.compare_digest(raw[:32], self._mac(raw[32:])):
            raise ValueError("invalid cursor")
        position, *bound, end = json.loads(raw[32:])
        if bound != [tool, principal, request] or now > end:
            raise ValueError("invalid cursor")
        return position
