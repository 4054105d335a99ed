"""Generations: immutable snapshots, staged, validated, published, rolled back and collected.

Rows of a generation are Parquet under ``generation_id=``; the states are small numbered JSON files, each made whole and
only if no other driver has made that number: of two drivers that step at once, one is told so. A write of a table is
announced before and recorded after it, so a reader never takes half a generation.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.evaluation import relation_hash
from lodestone.validate import ValidationError


class StateError(RuntimeError):
    """The generation is not in a state that allows the step, or its version has moved on."""


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table: one aggregation each, joined as single rows."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out


def left_counts(parents: DataFrame, key: str, chain: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Per row of ``parents``: its ``key`` and how many different rows of each table hang on it, down a chain of left joins.

    ``chain`` has (name, table, foreign key, own key): each table hangs on the one before. Rows are counted level by level,
    from the last to the first, so that no join multiplies rows.
    """
    out = None
    for name, table, foreign, own in reversed(chain):
        n = F.count(F.lit(1)).alias(name)
        if out is None:
            out = table.groupBy(F.col(foreign).alias("_up")).agg(n)
        else:
            deeper = [c for c in out.columns if c != "_up"]
            joined = table.select(F.col(foreign).alias("_key"), F.col(own).alias("_own")).join(out, F.col("_own") == F.col("_up"), "left")
            out = joined.groupBy(F.col("_key").alias("_up")).agg(n, *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in deeper])
    names = [c[0] for c in chain]
    return parents.select(key).join(out, F.col(key) == F.col("_up"), "left").select(key, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


def completeness(chunks: DataFrame, embeddings: DataFrame, edges: DataFrame, symbols: DataFrame, locations: DataFrame, files: DataFrame) -> DataFrame:
    """(rule, n) of what keeps a generation from being ready; no rows: it is complete."""
    def missing(left: DataFrame, right: DataFrame, a: str, b: str, rule: str) -> DataFrame:
        return left.select(F.col(a).alias("k")).where("k is not null").join(right.select(F.col(b).alias("k")), "k", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")

    rules = [
        missing(chunks, embeddings, "content_hash", "content_hash", "chunk without embedding"), missing(chunks, files, "file", "file_id", "chunk without file"),
        missing(chunks, symbols, "symbol_usr", "stable_usr", "chunk without symbol"), missing(edges, symbols, "src_usr", "stable_usr", "edge without source"),
        missing(edges, symbols, "dst_usr", "stable_usr", "edge without target"), missing(locations, symbols, "stable_usr", "stable_usr", "location without symbol"),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out.where("n > 0")


def retention(generations: DataFrame, running_backups: DataFrame, now: Column, days: int = 30, keep: int = 2, limit: int = 100, by: str = "project_id", claim: str | None = None) -> DataFrame:
    """Generations that may be collected: superseded, old and not among the newest ``keep`` valid ones, or failed and old.

    What a collection has claimed is left to it; with its own ``claim`` a collection that was broken off takes it up again.
    """
    if days < 7 or keep < 2:
        raise ValueError("at least 7 days and 2 generations")
    valid = F.col("status").isin("active", "superseded") & F.col("validated_at").isNotNull()
    newest = F.row_number().over(Window.partitionBy(by, valid).orderBy(F.desc("published_at"), F.desc("id")))
    old = now - F.make_dt_interval(F.lit(days))
    expired = ((F.col("status") == "superseded") & (F.col("published_at") < old) & valid & (F.col("_rank") > keep)) | ((F.col("status") == "failed") & (F.col("updated_at") < old))
    out = generations.withColumn("_rank", newest).where(expired & (F.col("gc_claim_hash").isNull() | F.coalesce(F.col("gc_claim_hash") == F.lit(claim), F.lit(False)))).drop("_rank")
    free = out.join(running_backups.select(F.col("generation_id").alias("id")), "id", "left_anti")
    return free.orderBy(F.coalesce("published_at", "updated_at"), "id").limit(limit)


def claimed(generations: DataFrame, candidates: DataFrame, claim: str, now: Column) -> DataFrame:
    """``generations`` in which the ``candidates`` (id) are claimed by ``claim``.

    A first claim sets its time and moves the version on; a claim of one's own, taken up again, changes nothing. A candidate
    that another one has claimed, or whose status has changed, raises when it is met.
    """
    rows = generations.join(candidates.select(F.col("id").alias("_mine")).distinct(), F.col("id") == F.col("_mine"), "left")
    mine, fresh = F.col("_mine").isNotNull(), F.col("_mine").isNotNull() & F.col("gc_claim_hash").isNull()
    lost = mine & ~(F.col("status").isin("superseded", "failed") & F.coalesce(F.col("gc_claim_hash") == F.lit(claim), F.lit(True)))
    version = F.when(lost, F.raise_error(F.concat(F.lit("not to be claimed: "), F.col("id").cast("string"))).cast("long"))
    new = {
        "gc_claim_hash": F.when(mine, F.lit(claim)).otherwise(F.col("gc_claim_hash")), "gc_claimed_at": F.when(mine, F.coalesce("gc_claimed_at", now)).otherwise(F.col("gc_claimed_at")),
        "publication_version": version.otherwise(F.col("publication_version") + fresh.cast("long")),
    }
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in generations.columns])


_DIGEST = "^[0-9a-f]{64}$"
RECEIPTS = "id string, manifest_uri string, manifest_hash string, idempotency_key string, receipt_hash string"


def artifact_deletions(collected: DataFrame, operation_id: str) -> DataFrame:
    """A row for each claimed generation with a manifest: what to delete, and the key under which that may be asked again.

    A manifest that only has a uri or only a digest, or a digest of another form, raises.
    """
    both = F.col("manifest_uri").isNotNull() & F.coalesce(F.col("manifest_hash").rlike(_DIGEST), F.lit(False))
    either = F.col("manifest_uri").isNotNull() | F.col("manifest_hash").isNotNull()
    request = F.to_json(F.struct(F.lit("gc-artifact-delete").alias("action"), F.col("id").cast("string").alias("generation_id"), "manifest_hash", F.lit(operation_id).alias("operation_id")))
    key = F.when(both, F.sha2(request, 256)).otherwise(F.raise_error(F.concat(F.lit("not a manifest: "), F.col("id").cast("string"))))
    return collected.where(either).select(F.col("id").cast("string").alias("id"), "manifest_uri", "manifest_hash", key.alias("idempotency_key"))


def delete_artifacts(deletions: DataFrame, delete) -> DataFrame:
    """Asks ``delete(generation, uri, digest, key)`` for each row, in tasks, and returns the receipts (64 hex digits each).

    A repeated task asks again under the same key, so ``delete`` has to know a key that it has answered. Anything that isn't
    a receipt raises. Store the receipts before anything reads them twice.
    """

    def run(batches):
        for pdf in batches:
            receipts = [delete(*row) for row in pdf[["id", "manifest_uri", "manifest_hash", "idempotency_key"]].itertuples(index=False, name=None)]
            wrong = [id for id, r in zip(pdf["id"], receipts) if not isinstance(r, str) or not re.fullmatch("[0-9a-f]{64}", r)]
            if wrong:
                raise ValueError(f"no receipt for {wrong[0]}")
            yield pdf.assign(receipt_hash=receipts)

    return deletions.mapInPandas(run, RECEIPTS)


def collected(generations: DataFrame, candidates: DataFrame, receipts: DataFrame, claim: str) -> DataFrame:
    """``generations`` without the ``candidates`` (id) that ``claim`` holds and whose manifest, if they have one, has a receipt.

    What is claimed but has no receipt stays, so that the next collection with the same claim takes it up.
    """
    done = receipts.where(F.col("receipt_hash").rlike(_DIGEST)).select(F.col("id").alias("_done"), F.col("manifest_hash").alias("_hash")).distinct()
    asked = candidates.select(F.col("id").alias("_asked")).distinct()
    rows = generations.join(asked, F.col("id") == F.col("_asked"), "left").join(done, (F.col("id").cast("string") == F.col("_done")) & (F.col("manifest_hash") == F.col("_hash")), "left")
    bare = F.col("manifest_uri").isNull() & F.col("manifest_hash").isNull()
    gone = F.col("_asked").isNotNull() & (F.col("gc_claim_hash") == F.lit(claim)) & F.col("status").isin("superseded", "failed") & (bare | F.col("_done").isNotNull())
    return rows.where(~F.coalesce(gone, F.lit(False))).select(*generations.columns)


def collection_audit(receipts: DataFrame, projects: DataFrame, operation_id: str, claim: str) -> DataFrame:
    """Per project of ``projects`` (id, project_id; what a collection claimed, bounded by its limit): one digest over its receipts."""
    own = projects.select(F.col("id").cast("string").alias("id"), "project_id").join(receipts.select("id", "receipt_hash"), "id", "left")
    told = F.sort_array(F.collect_list(F.when(F.col("receipt_hash").isNotNull(), F.struct(F.col("id").alias("generation_id"), "receipt_hash"))))
    rows = own.groupBy("project_id").agg(told.alias("receipts"), F.count(F.lit(1)).alias("generations"))
    request = F.to_json(F.struct(F.lit("gc-delete").alias("action"), F.lit(claim).alias("claim_hash"), F.lit(operation_id).alias("operation_id"), F.col("project_id").cast("string").alias("project_id"), "receipts"))
    return rows.select("project_id", "generations", F.size("receipts").cast("long").alias("artifacts"), F.sha2(request, 256).alias("audit_hash"))


@dataclass(frozen=True)
class Generation:
    id: str
    project_id: str
    status: str = "building"
    publication_version: int = 1
    counts: dict = field(default_factory=dict)
    payload: dict = field(default_factory=dict)
    gc_claim: str | None = None
    writing: str | None = None


class Registry:
    """The states of all generations; every step names the version it has seen.

    ``path`` is a folder of a mounted store, or with ``spark`` of any store that its file systems can open. State n + 1 is
    made from state n under a name of its own and then linked or renamed to its number, which fails if that is there.
    """

    KEPT = 8  # states that stay, so that a reader who has listed one can still open it

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self.spark, self.seen, self.owner = path, spark, 0, uuid.uuid4().hex

    def _store(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        if self.spark:
            _, root, store = self._store()
            return [f.getPath().getName() for f in store.listStatus(root)] if store.exists(root) else []
        return os.listdir(self.path) if os.path.isdir(self.path) else []

    def _read(self, name: str) -> str:
        if self.spark:
            return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]
        with open(f"{self.path}/{name}") as f:
            return f.read()

    def load(self) -> dict[str, Generation]:
        numbers = [int(n[6:-5]) for n in self._names() if re.fullmatch(r"state-[0-9]+\.json", n)]
        self.seen = max(numbers, default=0)
        return {k: Generation(**v) for k, v in json.loads(self._read(f"state-{self.seen}.json")).items()} if numbers else {}

    def _save(self, rows: dict[str, Generation]) -> None:
        """Makes the state that follows the one loaded last."""
        text, part, name = json.dumps({k: asdict(v) for k, v in rows.items()}, sort_keys=True), f"{uuid.uuid4().hex}.part", f"state-{self.seen + 1}.json"
        if self.spark:
            jvm, root, store = self._store()
            out = store.create(jvm.org.apache.hadoop.fs.Path(root, part), False)
            out.write(bytearray(text.encode()))
            out.close()
            at = lambda n: jvm.org.apache.hadoop.fs.Path(root, n)
            made = not store.exists(at(name)) and store.rename(at(part), at(name))
            drop = lambda n: store.delete(at(n), False)
        else:
            os.makedirs(self.path, exist_ok=True)
            with open(f"{self.path}/{part}", "w") as f:
                f.write(text)
            try:
                os.link(f"{self.path}/{part}", f"{self.path}/{name}")
                made = True
            except FileExistsError:
                made = False
            os.unlink(f"{self.path}/{part}")
            drop = lambda n: os.path.exists(f"{self.path}/{n}") and os.unlink(f"{self.path}/{n}")
        if not made:
            raise StateError("another driver has moved the states on")
        self.seen += 1
        if self.seen > self.KEPT:
            drop(f"state-{self.seen - self.KEPT}.json")

    def _step(self, id: str, version: int, allowed: tuple[str, ...], **change) -> Generation:
        rows = self.load()
        now = rows.get(id)
        if now is None or now.publication_version != version or now.status not in allowed:
            raise StateError(f"{id}: {now.status if now else 'unknown'}, version {now.publication_version if now else 0}")
        rows[id] = replace(now, publication_version=version + 1, **change)
        self._save(rows)
        return rows[id]

    def stage(self, id: str, project: str) -> Generation:
        """A new generation; staging the same one again changes nothing."""
        rows = self.load()
        if id in rows:
            if rows[id].project_id != project:
                raise StateError(f"{id} belongs to another project")
            return rows[id]
        rows[id] = Generation(id, project)
        self._save(rows)
        return rows[id]

    def record(self, id: str, name: str, df: DataFrame, root: str, take_over: bool = False) -> Generation:
        """Writes one table of a building generation; the same rows again change nothing, others are an error.

        The write is announced under a version check before anything is written. What another driver has announced and
        not recorded is its own, unless ``take_over`` says that this driver has ended.
        """
        now = self.load()[id]
        if now.status != "building":
            raise StateError(f"{id}: {now.status}")
        digest = relation_hash(df, *sorted(df.columns)).first()
        if name in now.payload:
            if now.payload[name] != digest["payload_hash"]:
                raise StateError("dirty-generation")
            return now
        if now.writing and not now.writing.endswith(self.owner) and not take_over:
            raise StateError(f"{id}: another driver writes {now.writing.split(':')[0]}")
        now = self._step(id, now.publication_version, ("building",), writing=f"{name}:{self.owner}")
        df.write.mode("overwrite").parquet(f"{root}/{name}/generation_id={id}")
        return self._step(id, now.publication_version, ("building",), counts=now.counts | {name: digest["n"]}, payload=now.payload | {name: digest["payload_hash"]}, writing=None)

    def validate(self, id: str, version: int, faults: DataFrame) -> Generation:
        """building -> ready, or -> failed with an error if ``faults`` (rule, n) has rows."""
        if bad := faults.collect():
            self._step(id, version, ("building",), status="failed")
            raise ValidationError("; ".join(f"{r['rule']}: {r['n']}" for r in bad))
        return self._step(id, version, ("building",), status="ready")

    def _activate(self, id: str, version: int, allowed: str) -> Generation:
        rows = self.load()
        if id not in rows or rows[id].publication_version != version or rows[id].status != allowed or rows[id].gc_claim:
            raise StateError(f"{id} can't become active")
        for k, v in rows.items():
            if v.project_id == rows[id].project_id and v.status == "active":
                rows[k] = replace(v, status="superseded", publication_version=v.publication_version + 1)
        rows[id] = replace(rows[id], status="active", publication_version=version + 1)
        self._save(rows)  # both changes at once
        return rows[id]

    def publish(self, id: str, version: int) -> Generation:
        return self._activate(id, version, "ready")

    def rollback(self, id: str, version: int) -> Generation:
        return self._activate(id, version, "superseded")

    def claim(self, id: str, version: int, token: str) -> Generation:
        """First phase of a collection; afterwards the artifacts are deleted, then ``forget`` drops the state."""
        return self._step(id, version, ("superseded", "failed"), gc_claim=token)

    def forget(self, id: str, token: str) -> None:
        rows = self.load()
        if id not in rows or rows[id].gc_claim != token:
            raise StateError(f"{id} isn't claimed")
        del rows[id]
        self._save(rows)

    def active(self, project: str) -> Generation | None:
        return next((g for g in self.load().values() if g.project_id == project and g.status == "active"), None)
