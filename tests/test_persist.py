"""What the sinks check and write."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import text as tx
from lodestone.operators import chunks, evaluation, generations, persist
from lodestone.sources import extraction
from lodestone.validate import ValidationError
from tests.test_index import symbol


def test_symbols_for_the_store(spark):
    rows = spark.createDataFrame([symbol("a"), symbol("b", owner="a"), symbol("c", owner="lost")], schemas.SYMBOL)
    files = spark.createDataFrame([("r/a.h", "f1")], "path string, file_id string")
    kept, places = persist.symbol_rows(rows, files)
    assert {r.stable_usr: r.owner_usr for r in kept.collect()} == {"a": None, "b": "a", "c": None}
    assert {r.file_id for r in places.collect()} == {"f1"}
    with pytest.raises(ValidationError):
        persist.symbol_rows(rows, files.where("false"))
    with pytest.raises(ValidationError):
        persist.symbol_rows(rows.union(rows), files)


def test_relations_coalesce_without_columns(spark):
    edges = spark.createDataFrame([("calls", "a", "b", c, "f", 1, k) for k, c in ((1, 0.5), (9, 0.9))] + [("calls", "a", "b", 0.4, None, None, None)], schemas.SYMBOL_EDGE)
    includes = spark.createDataFrame([("a", "b", 1, 1), ("a", "b", 2, 1)], "src_file string, dst_file string, line int, column int")
    got, pairs = persist.relation_rows(edges, includes)
    assert {(r.file, r.confidence) for r in got.collect()} == {("f", 0.9), (None, 0.4)} and pairs.count() == 1


def test_chunks_and_vectors_are_checked(spark):
    made, _ = chunks.make_chunks(spark.createDataFrame([symbol("f", end=11)], schemas.SYMBOL), spark.createDataFrame([("r/a.h", "int f(){};")], "file string, text string"))
    assert persist.chunk_rows(made).count() == 1
    for column, value in (("content_hash", F.lit("x")), ("token_count", F.lit(99)), ("stable_key", F.lit("x")), ("text", F.concat("text", F.lit("!")))):
        with pytest.raises(ValidationError):
            persist.chunk_rows(made.withColumn(column, value))
    vectors = made.select("content_hash", F.lit("p").alias("provider"), F.lit("m").alias("model"), F.lit(2).alias("dimensions"), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>").alias("embedding"))
    assert persist.embedding_rows(vectors, made).count() == 1
    with pytest.raises(ValidationError):
        persist.embedding_rows(vectors.withColumn("embedding", F.array(F.lit(float("nan")), F.lit(0.0)).cast("array<float>")), made)
    with pytest.raises(generations.StateError):
        persist.embedding_rows(vectors.withColumn("content_hash", F.lit("other")), made)


def test_a_build_is_written_once(spark, tmp_path):
    book = generations.Registry(str(tmp_path / "state.json"))
    book.stage("g", "p")
    rows = spark.createDataFrame([(1, "x")], "id int, t string")
    first = persist.write_build(book, "g", str(tmp_path), {"a": rows, "b": rows})
    assert persist.write_build(book, "g", str(tmp_path), {"a": rows, "b": rows}) == first and first.counts == {"a": 1, "b": 1}
    assert spark.read.parquet(f"{tmp_path}/a").first().generation_id == "g"


def test_upserts_respect_their_guard(spark):
    rows = spark.createDataFrame([("a", "online", 1), ("b", "revoked", 1)], "id string, status string, n int")
    changes = spark.createDataFrame([("a", "online", 2), ("b", "online", 2), ("c", "online", 2)], rows.schema)
    assert {tuple(r) for r in persist.upsert(rows, changes, "id", F.col("old.status") != "revoked").collect()} == {("a", "online", 2), ("b", "revoked", 1), ("c", "online", 2)}
    assert {r.n for r in persist.upsert(rows, changes, "id").collect()} == {2}


def test_statement_batches_keep_all_rows(spark):
    rows = spark.range(25).withColumn("t", F.repeat(F.lit("é"), F.col("id").cast("int")))
    got = persist.statement_batches(rows, 4, 200).collect()
    assert all(r.rows <= 4 and len(r.payload.encode()) <= 200 and len(json.loads(r.payload)) == r.rows for r in got)
    assert sorted(x["id"] for r in got for x in json.loads(r.payload)) == list(range(25))
    with pytest.raises(Exception, match="longer than a batch"):
        persist.statement_batches(rows, 4, 30).collect()


def test_revision_sets_hash_alike_in_any_order():
    a, b = {"repository_id": "a", "revision": 1}, {"revision": 2, "repository_id": "b"}
    assert persist.revision_set_hash([a, b]) == persist.revision_set_hash([b, a]) != persist.revision_set_hash([a])
    with pytest.raises(ValueError):
        persist.revision_set_hash([a, a])


def test_prometheus_text(spark):
    rows = spark.createDataFrame([("x", 3.0), ("x", 70.0), ("y", 1e6)], "kind string, ms double")
    text = persist.prometheus_text(evaluation.histogram(rows, "ms", ["kind"], (5, 100)), "latency", ("kind",))
    assert text[:4] == ["# TYPE latency histogram", 'latency_bucket{kind="x",le="5"} 1', 'latency_bucket{kind="x",le="100"} 2', 'latency_bucket{kind="y",le="5"} 0']
    assert 'latency_bucket{kind="y",le="+Inf"} 1' in text and 'latency_sum{kind="x"} 73' in text and 'latency_count{kind="x"} 2' in text


INFO = '<info><entry kind="dir" path="." revision="9"><url>u</url><repository><root>r</root><uuid>id</uuid></repository><commit revision="7"><author>ann</author><date>2024-01-02T03:04:05.000000Z</date></commit></entry></info>'
DIFF = '<diff><paths><path item="modified" kind="file" props="none">a.c</path><path item="added" kind="dir" props="none">d</path></paths></diff>'


def test_info_and_diff_documents(spark):
    xml = lambda text: spark.createDataFrame([(text,)], "xml string")
    info = extraction.from_info_xml(xml(INFO)).first()
    assert (info.kind, info.path, info.revision, info.url, info.root, info.uuid, info.commit_revision, info.author) == ("dir", ".", 9, "u", "r", "id", 7, "ann")
    assert {tuple(r) for r in extraction.from_diff_xml(xml(DIFF)).collect()} == {("a.c", "modified", "file"), ("d", "added", "dir")}
    with pytest.raises(ValidationError):
        extraction.from_diff_xml(xml("<!DOCTYPE x>" + DIFF)).count()


def test_corpus_walk_counts_what_parses(spark, tmp_path):
    from lodestone.sources import code

    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "A.Build.cs").write_text("class A : ModuleRules { }")
    (tmp_path / "m" / "B.Build.cs").write_text("class B { }")
    (tmp_path / "m" / "G.Target.cs").write_text("class G : TargetRules { Type = TargetType.Game; }")
    (tmp_path / "P.uplugin").write_text('{"Modules": []}')
    (tmp_path / "Q.uproject").write_text("{broken")
    (tmp_path / "x.txt").write_text("no")
    got = {(r.kind, r.parsed): r.n for r in code.corpus_audit(code.walk(spark, str(tmp_path))).collect()}
    assert got == {("module", True): 1, ("module", False): 1, ("target", True): 1, ("plugin", True): 1, ("project", False): 1}
