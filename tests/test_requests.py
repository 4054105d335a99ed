"""Response files, security events, rerank requests, checkpoints and the rules of an extraction stream."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, persist
from lodestone.plans import hybrid
from lodestone.sources import code, extraction
from lodestone.validate import ValidationError

FILES = [("/w/a.rsp", '-DA "-I/x y"\r\n@sub/b.rsp'), ("/w/sub/b.rsp", "-DB"), ("/w/loop.rsp", "@loop.rsp"), ("/else/c.rsp", "-DC")]


def test_response_files_are_expanded_in_place(spark):
    files = spark.createDataFrame(FILES, "path string, text string")
    commands = lambda *rows: spark.createDataFrame([(i, "/w", r) for i, r in enumerate(rows)], "id int, directory string, command string")
    got = {r.id: r.arguments for r in code.expand_responses(commands('cl "@./a.rsp" -c f.cpp', "cl f.cpp"), files, ["/w"]).collect()}
    assert got == {0: ["cl", "-DA", "-I/x y", "-DB", "-c", "f.cpp"], 1: ["cl", "f.cpp"]}
    for bad, match in (("cl @loop.rsp", "too deep"), ("cl @none.rsp", "is there"), ("cl @../else/c.rsp", "below a root")):
        with pytest.raises(ValidationError, match=match):
            code.expand_responses(commands(bad), files, ["/w"])


GOOD = ("user", "ann", "search.run", None, "search_code", "allowed", "a" * 64, "0a0a0a0a-0000-4000-8000-000000000001", "1" * 32, "2" * 16, "chunk", "k1", None)


def test_security_events_are_checked_before_they_are_written(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(list(rows), persist.AUDIT)
    persist.append_audit(make(GOOD), f"{tmp_path}/audit")
    persist.append_audit(make((*GOOD[:4], "tools/search:v1", *GOOD[5:7], GOOD[7].upper(), *GOOD[8:10], "r" * 64, "k1", "E/1")), f"{tmp_path}/audit")
    assert spark.read.parquet(f"{tmp_path}/audit").count() == 2
    for i, bad in ((0, "robot"), (1, "a\nb"), (1, ""), (2, "Run It"), (3, "x"), (5, "maybe"), (6, "a" * 63), (7, None), (8, "0" * 32), (9, "0" * 16), (12, "not a token"), (10, "r" * 65), (7, "0a0a0a0a-0000-7000-8000-000000000001"), (7, "0a0a0a0a-0000-4000-c000-000000000001")):
        row = (*GOOD[:i], bad, *GOOD[i + 1 :])
        with pytest.raises(ValidationError):
            persist.append_audit(make(GOOD, row), f"{tmp_path}/audit")
    assert spark.read.parquet(f"{tmp_path}/audit").count() == 2


def test_rerank_requests_are_gated_bounded_and_tried_again(spark):
    rows = spark.createDataFrame([("k1", "one", 1), ("k2", "two", 2)], "chunk_key string, text string, rank int")
    keys = []

    def flaky(query, texts, key):
        keys.append(key)
        if len(keys) == 1:
            raise ConnectionError
        return {k: 0.25 * len(t) for k, t in texts}

    provider = lambda call, **more: hybrid.Reranker("p", "m", call, approved=True, **more)
    assert {r.chunk_key: r.score for r in hybrid.rerank_scores(rows, provider(flaky), "proj", "q").collect()} == {"k1": 0.75, "k2": 0.75}
    assert len(keys) == 2 and len(set(keys)) == 1
    for call in (lambda q, t, k: {"k1": 0.5}, lambda q, t, k: {"k1": 0.5, "k2": 1.5}, lambda q, t, k: {"k1": float("nan"), "k2": 0.1}):
        with pytest.raises(ValueError, match="pair off"):
            hybrid.rerank_scores(rows, provider(call), "proj", "q")
    for refused in (hybrid.Reranker("p", "m", flaky), provider(flaky, enabled=False)):
        with pytest.raises(PermissionError):
            hybrid.rerank_scores(rows, refused, "proj", "q")
    for bad in (rows.withColumn("text", F.lit("")), rows.withColumn("text", F.lit("x" * 70_000)), rows.withColumn("chunk_key", F.lit("k")), rows.limit(0), rows.crossJoin(spark.range(60)).withColumn("chunk_key", F.concat("chunk_key", "id"))):
        with pytest.raises(ValueError, match="request"):
            hybrid.rerank_scores(bad, provider(flaky), "proj", "q")


def test_checkpoints_are_numbered_whole_and_verified(spark, tmp_path):
    path, rows = str(tmp_path / "steps"), spark.range(5).withColumn("t", F.lit("x"))
    first = extraction.write_checkpoint(rows, path, 0, "plan")
    assert extraction.write_checkpoint(rows.orderBy(F.desc("id")), path, 0, "plan") == first
    with pytest.raises(ValidationError, match="other rows"):
        extraction.write_checkpoint(rows.limit(2), path, 0, "plan")
    with pytest.raises(ValidationError, match="comes next"):
        extraction.write_checkpoint(rows, path, 2, "plan")
    extraction.write_checkpoint(rows.limit(3), path, 1, "plan")
    assert extraction.read_checkpoints(spark, path, "plan").count() == 8
    rows.limit(1).withColumn("plan_hash", F.lit("plan")).write.mode("append").parquet(f"{path}/batch=1")
    with pytest.raises(ValidationError, match="batch 1"):
        extraction.read_checkpoints(spark, path, "plan")


def test_streams_begin_with_their_manifest(spark, tmp_path):
    manifest = lambda v: {"type": "manifest", "schema_version": v, "libclang": "x", "diagnostic_count": 0, "error_count": 0}
    sym = lambda **more: {"type": "symbol", "kind": "class", "usr": "u", "name": "A", "display_name": "A", "qualified_name": "A", "is_definition": True, "file": "/r/a.h", "start_line": 1, "start_column": 1, "end_line": 1, "end_column": 5, "type_spelling": "", "result_type": "", "owner_usr": None, "documentation": None, **more}
    edge = {"type": "symbol_edge", "edge_type": "calls", "src_usr": "a", "dst_usr": "b", "file": "/r/a.h", "line": 1, "column": 1, "confidence": 1.0}

    def read(name, *lines):
        (tmp_path / name).write_text("\n".join(map(json.dumps, lines)))
        return extraction.read_extraction(spark, str(tmp_path / name), ["/r"])

    got = read("ok", manifest(2), sym(), sym(usr=None), sym(qualified_name="a/b"), sym(usr="v", qualified_name="T::operator/"), sym(usr="w", end_column=0), edge)
    assert sorted(r.stable_usr for r in got["symbols"].collect()) == ["u", "v"] and got["unidentified"].count() == 3 and got["symbol_edges"].count() == 1
    for name, lines in (("late", (sym(), manifest(2))), ("none", (sym(),)), ("two", (manifest(2), manifest(2))), ("old", (manifest(1), edge))):
        with pytest.raises(ValidationError):
            read(name, *lines)


def test_edges_in_the_order_of_a_locale(spark):
    rows = spark.createDataFrame([("calls", x, "d", None, None, None, 1.0) for x in ("b", "B", "a", "ä", "Z")], "edge_type string, src_usr string, dst_usr string, file string, line int, column int, confidence double")
    assert [r.src_usr for r in graph.in_order(rows).collect()] == ["B", "Z", "a", "b", "ä"]
    assert [r.src_usr for r in graph.in_order(rows, "UNICODE").collect()] == ["a", "ä", "b", "B", "Z"]
