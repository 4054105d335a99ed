"""Rows of a build as the store takes them: narrowed, coalesced again, checked against what is there, and written once."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import content_hash, token_estimate
from lodestone.operators.chunks import stable_key
from lodestone.operators.generations import Generation, Registry, StateError
from lodestone.validate import require, require_unique

#: Rows and bytes of JSON that one statement of a sink takes at most.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def symbol_rows(symbols: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols, locations) for the store. Every location must be in a known file and every identity unique; owners that
    are no symbols become null."""
    require_unique(symbols, "stable_usr")
    places = symbols.select("stable_usr", F.explode("locations").alias("at")).select("stable_usr", "at.*")
    known = files.select("path", "file_id")
    placed = places.join(known, places["file"] == known["path"], "left").drop("path")
    require(placed, {"location in a known file": F.col("file_id").isNotNull()})
    owners = symbols.select(F.col("stable_usr").alias("_owner"))
    linked = symbols.join(owners, F.col("owner_usr") == F.col("_owner"), "left")
    return linked.withColumn("owner_usr", F.col("_owner")).drop("_owner", "locations"), placed


def relation_rows(edges: DataFrame, includes: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, includes) for the store, which has no columns of a line: edges that differ in these alone become one, with
    the largest confidence, and includes become one per pair of files. With ``files`` (path, file_id), paths are resolved
    to ids: evidence is optional, but a path that is given must be a known file, as must both ends of an include."""
    out, pairs = edges.groupBy("edge_type", "src_usr", "dst_usr", "file", "line").agg(F.max("confidence").alias("confidence")), includes.select("src_file", "dst_file").distinct()
    if files is None:
        return out, pairs

    def resolved(df: DataFrame, path: str) -> DataFrame:
        known = files.select(F.col("path").alias("_path"), F.col("file_id").alias("_id"))
        joined = df.join(known, df[path] == known["_path"], "left")
        require(joined, {f"{path} is a known file": F.col(path).isNull() | F.col("_id").isNotNull()})
        return joined.drop("_path", path).withColumnRenamed("_id", f"{path}_id")

    return resolved(out, "file"), resolved(resolved(pairs, "src_file"), "dst_file")


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """``chunks`` whose content hash, token count and stable key are what their fields say; others raise."""
    require(chunks, {
        "content hash": F.col("content_hash") == content_hash(F.col("text")), "token count": F.col("token_count") == token_estimate(F.col("text")),
        "stable key": F.col("stable_key") == stable_key(), "part": F.col("part_index").between(0, F.col("part_count") - 1),
    })
    return require_unique(chunks, "stable_key")


def embedding_rows(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """One vector per content of one profile, each of its own dimension and finite, each of a chunk that is there."""
    bad = F.exists("embedding", lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))
    require(vectors, {"dimensions": F.size("embedding") == F.col("dimensions"), "finite": ~bad})
    require_unique(vectors, "content_hash", "provider", "model", "dimensions")
    strays = vectors.join(chunks.select("content_hash"), "content_hash", "left_anti")
    if not strays.isEmpty():
        raise StateError("dirty-generation")
    return vectors


def write_build(book: Registry, generation: str, root: str, tables: dict[str, DataFrame]) -> Generation:
    """Writes the tables of a building generation in turn; a repeat changes nothing, other rows raise."""
    now = None
    for name, df in tables.items():
        now = book.record(generation, name, df, root)
    return now


def upsert(rows: DataFrame, changes: DataFrame, key: str, guard: Column | None = None) -> DataFrame:
    """``rows`` with those of ``changes`` (same columns) put in; ``guard`` says of an old row (``old``) whether it may change."""
    old, new = rows.select(F.col(key), F.struct(*rows.columns).alias("old")), changes.select(F.col(key), F.struct(*rows.columns).alias("new"))
    both = old.join(new, key, "full")
    takes = F.col("new").isNotNull() & (F.col("old").isNull() | (F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))))
    return both.select(F.when(takes, F.col("new")).otherwise(F.col("old")).alias("row")).select("row.*")


#: Columns of a security event, in the order of the store.
AUDIT = (
    "actor_type string, actor_id string, action string, project_id string, tool string, outcome string, request_hash string, correlation_id string, trace_id string, span_id string, "
    "resource_type string, resource_id string, error_code string"
)
#: Their forms.
_UUID, _TOKEN = "(?i)^[a-f0-9]{8}-[a-f0-9]{4}-[1-5][a-f0-9]{3}-[89ab][a-f0-9]{3}-[a-f0-9]{12}$", "^[A-Za-z0-9][A-Za-z0-9_.:/-]{0,127}$"
_NAME, _RESOURCE = "^[a-z][a-z0-9_.-]{0,127}$", "^[a-z][a-z0-9_.-]{0,63}$"


def audit_rows(events: DataFrame) -> DataFrame:
    """Security events as the store takes them: 13 columns, each of its form; any other row raises."""
    line = lambda c: F.length(c).between(1, 512) & ~F.col(c).rlike("[\\r\\n\\x00]")
    like = lambda c, form, null=False: F.col(c).rlike(form) | (F.col(c).isNull() if null else F.lit(False))
    return require(events.select(*[x.split()[0] for x in AUDIT.split(", ")]), {
        "actor": F.col("actor_type").isin("user", "service", "agent", "system") & line("actor_id"), "action": like("action", _NAME), "project": like("project_id", _UUID, True), "tool": like("tool", _TOKEN, True),
        "outcome": F.col("outcome").isin("allowed", "denied", "succeeded", "failed"), "request hash": like("request_hash", "^[0-9a-f]{64}$"), "correlation": like("correlation_id", _UUID),
        "trace": like("trace_id", "^[0-9a-f]{32}$") & (F.col("trace_id") != "0" * 32), "span": like("span_id", "^[0-9a-f]{16}$") & (F.col("span_id") != "0" * 16),
        "resource": like("resource_type", _RESOURCE, True) & (F.col("resource_id").isNull() | line("resource_id")), "error": like("error_code", _TOKEN, True),
    })


def append_audit(events: DataFrame, path: str) -> None:
    """Appends checked security events; nothing is written if one row is not of its form."""
    audit_rows(events).write.mode("append").parquet(path)


def statement_batches(rows: DataFrame, most_rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """(rows, payload): JSON arrays under both limits, cut within each task; a row that is too long by itself raises."""

    def run(parts):
        import pandas as pd

        now, size = [], 0
        for pdf in parts:
            for text in pdf["j"]:
                n = len(text.encode()) + 1
                if n + 1 > most_bytes:
                    raise ValueError("a row is longer than a batch")
                if now and (len(now) >= most_rows or size + n + 1 > most_bytes):
                    yield pd.DataFrame({"rows": [len(now)], "payload": [f"[{','.join(now)}]"]})
                    now, size = [], 0
                now.append(text)
                size += n
        if now:
            yield pd.DataFrame({"rows": [len(now)], "payload": [f"[{','.join(now)}]"]})

    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("j")).mapInPandas(run, "rows int, payload string")


def revision_set_hash(repositories: list[dict]) -> str:
    """SHA-256 of the repositories and their revisions in the order of their ids, as canonical JSON."""
    ids = [r["repository_id"] for r in repositories]
    if not ids or len(set(ids)) < len(ids):
        raise ValueError("one entry per repository")
    ordered = sorted(repositories, key=lambda r: r["repository_id"])
    return hashlib.sha256(json.dumps(ordered, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def prometheus_text(hist: DataFrame, name: str, by: tuple[str, ...] = ()) -> list[str]:
    """A histogram (by, le, n, total, sum) in the text exposition format; one driver row per bucket and label set."""
    rows = sorted(hist.collect(), key=lambda r: ([str(r[b]) for b in by], r["le"]))
    labels = lambda r, *more: ",".join([f'{b}="{r[b]}"' for b in by] + list(more))
    out, seen = [f"# TYPE {name} histogram"], {}
    for r in rows:
        out.append(f'{name}_bucket{{{labels(r, f"le=\"{r["le"]:g}\"")}}} {r["n"]}')
        seen[labels(r)] = r
    for key, r in seen.items():
        inf = 'le="+Inf"'
        tail = f"{{{key}}}" if key else ""
        out += [f"{name}_bucket{{{labels(r, inf)}}} {r['total']}", f"{name}_sum{tail} {r['sum'] or 0:g}", f"{name}_count{tail} {r['total']}"]
    return out
