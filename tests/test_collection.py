"""Collections: own claims taken up again, those of others left alone, artifacts deleted under keys that may be asked again."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from lodestone.operators import generations

OLD, NOW = dt.datetime(2020, 1, 1), dt.datetime(2024, 1, 1)
MINE, OTHER = "1" * 64, "2" * 64
DDL = "id string, project_id string, status string, published_at timestamp, updated_at timestamp, validated_at timestamp, publication_version long, gc_claim_hash string, gc_claimed_at timestamp, manifest_uri string, manifest_hash string"


def row(id, status="failed", claim=None, manifest="m", at=OLD, project="p"):
    digest = hashlib.sha256(manifest.encode()).hexdigest() if manifest else None
    return (id, project, status, at if status != "failed" else None, at, at if status != "failed" else None, 3, claim, OLD if claim else None, manifest and f"s3/{manifest}", digest)


def candidates(rows, claim=None, running=(), **kw):
    backups = rows.where(F.col("id").isin(*running)).select(F.col("id").alias("generation_id"))
    return generations.retention(rows, backups, F.lit(NOW), claim=claim, **kw)


@pytest.fixture(scope="module")
def rows(spark):
    data = [row("a"), row("b", claim=MINE), row("c", claim=OTHER), row("d", manifest=None), row("e", "building"), row("f", at=NOW), row("g")]
    data += [row(f"s{i}", "superseded", at=OLD + dt.timedelta(days=i), project="q") for i in range(4)] + [row("s9", "active", at=NOW, project="q")]
    return spark.createDataFrame(data, DDL)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_claims_of_one_and_of_others(rows):
    assert ids(candidates(rows)) == ["a", "d", "g", "s0", "s1", "s2"]
    assert ids(candidates(rows, MINE, running=["g"])) == ["a", "b", "d", "s0", "s1", "s2"]
    assert ids(candidates(rows, OTHER, running=["g"], limit=2)) == ["a", "c"]
    assert ids(candidates(rows.limit(0), MINE)) == []


def test_a_claim_moves_the_version_on_once(rows):
    now = F.lit(NOW)
    some = candidates(rows, MINE)
    once = generations.claimed(rows, some, MINE, now)
    got = {r.id: (r.publication_version, r.gc_claim_hash, r.gc_claimed_at) for r in once.collect()}
    assert got["a"] == (4, MINE, NOW) and got["b"] == (3, MINE, OLD) and got["c"] == (3, OTHER, OLD) and got["e"] == (3, None, None)
    again = generations.claimed(once, candidates(once, MINE).unionByName(some), MINE, now)  # rows that come twice are one
    assert {r.id: (r.publication_version, r.gc_claim_hash, r.gc_claimed_at) for r in again.collect()} == got
    assert ids(candidates(once, OTHER)) == ["c"]
    for lost in ("c", "e"):
        with pytest.raises(Exception, match="not to be claimed"):
            generations.claimed(rows, rows.where(F.col("id") == lost), MINE, now).collect()


def answer(id, uri, digest, key):
    return hashlib.sha256(f"{id}|{uri}|{digest}|{key}".encode()).hexdigest()


def test_artifacts_go_before_their_generations(rows):
    some = candidates(rows, MINE)
    held = generations.claimed(rows, some, MINE, F.lit(NOW))
    deletions = generations.artifact_deletions(held.join(some.select("id"), "id"), "op")
    got = {r.id: r for r in generations.delete_artifacts(deletions, answer).collect()}
    assert sorted(got) == ["a", "b", "g", "s0", "s1", "s2"]
    for id, r in got.items():
        request = json.dumps({"action": "gc-artifact-delete", "generation_id": id, "manifest_hash": r.manifest_hash, "operation_id": "op"}, separators=(",", ":"))
        assert r.idempotency_key == hashlib.sha256(request.encode()).hexdigest()
        assert r.receipt_hash == answer(id, r.manifest_uri, r.manifest_hash, r.idempotency_key)
    receipts = generations.delete_artifacts(deletions.where("id <> 'g'"), answer)
    left = generations.collected(held, some, receipts.unionByName(receipts), MINE)
    assert ids(left) == sorted(set(ids(rows)) - set(ids(some)) | {"g"})  # no receipt: it stays, claimed
    assert ids(candidates(left, MINE)) == ["g"] and ids(candidates(left)) == []
    later = generations.artifact_deletions(left.where("id = 'g'"), "op").first()
    assert later.idempotency_key == got["g"].idempotency_key
    assert ids(generations.collected(held, some, receipts.limit(0), MINE)) == sorted(set(ids(rows)) - {"d"})
    assert ids(generations.collected(held, some, receipts, OTHER)) == ids(rows)


def test_what_is_no_receipt_or_no_manifest_raises(rows, spark):
    deletions = generations.artifact_deletions(rows.where("id = 'a'"), "op")
    for wrong in (None, "", "A" * 64, "1" * 63, 7):
        with pytest.raises(PythonException, match="no receipt for a"):
            generations.delete_artifacts(deletions, lambda *_, wrong=wrong: wrong).collect()
    for uri, digest in (("u", None), (None, "1" * 64), ("u", "1" * 63), ("u", "A" * 64)):
        odd = spark.createDataFrame([("x", uri, digest)], "id string, manifest_uri string, manifest_hash string")
        with pytest.raises(Exception, match="not a manifest"):
            generations.artifact_deletions(odd, "op").collect()
    assert generations.delete_artifacts(deletions.limit(0), answer).count() == 0


def test_one_audit_digest_a_project(rows):
    some = candidates(rows, MINE)
    receipts = generations.delete_artifacts(generations.artifact_deletions(some, "op"), answer)
    got = {r.project_id: r for r in generations.collection_audit(receipts, some, "op", MINE).collect()}
    told = {r.id: r.receipt_hash for r in receipts.collect()}
    for project, own in (("p", ["a", "b", "d", "g"]), ("q", ids(some.where("project_id = 'q'")))):
        listed = [{"generation_id": i, "receipt_hash": told[i]} for i in own if i in told]
        request = json.dumps({"action": "gc-delete", "claim_hash": MINE, "operation_id": "op", "project_id": project, "receipts": listed}, separators=(",", ":"))
        r = got[project]
        assert (r.generations, r.artifacts, r.audit_hash) == (len(own), len(listed), hashlib.sha256(request.encode()).hexdigest())
