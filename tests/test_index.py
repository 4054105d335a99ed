"""Symbols, relations, chunks, embeddings, generations: literals of small builds."""

import hashlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.functions import text as tx
from lodestone.operators import chunks, embedding, evaluation, generations, graph, symbols
from lodestone.validate import ValidationError, require_unique


def symbol(usr, line=1, doc=None, kind="function", result="int", owner=None, file="r/a.h", end=9):
    return (usr, f"N::{usr}", usr, usr, kind, "", result, [("definition", file, line, 1, line, end)], owner, doc)


@pytest.fixture(scope="module")
def some(spark):
    return spark.createDataFrame([symbol("f", doc="short", result=""), symbol("f", 2, doc="a longer text"), symbol("f", 2), symbol("g"), symbol("g", kind="class"), symbol("h", owner="f"), symbol("i", owner="lost")], schemas.SYMBOL)


def test_symbols_merge_and_conflicts_drop(some):
    merged, ambiguous = symbols.merge_symbols(some)
    rows = {r.stable_usr: r for r in merged.collect()}
    assert set(rows) == {"f", "h", "i"} and rows["f"].documentation == "a longer text" and rows["f"].result_type == "int"
    assert [p.start_line for p in rows["f"].locations] == [1, 2]
    assert [tuple(r) for r in ambiguous.collect()] == [("g", 2)]


def test_a_clean_batch_brings_an_identity_back(spark, some):
    batches = some.withColumn("b", F.lit(0)).unionByName(spark.createDataFrame([symbol("g")], schemas.SYMBOL).withColumn("b", F.lit(1)))
    merged, ambiguous = symbols.merge_symbols(batches, "b")
    assert "g" in {r.stable_usr for r in merged.collect()} and [tuple(r) for r in ambiguous.collect()] == [("g", 2)]


def test_documentation_and_annotations_attach(spark, some):
    merged, _ = symbols.merge_symbols(some)
    docs = spark.createDataFrame([(hashlib.sha1(b"h").hexdigest(), "of h"), (hashlib.sha1(b"f").hexdigest(), "tiny")], "documentation_id string, text string")
    said = {r.stable_usr: r.documentation for r in symbols.attach_documentation(merged, docs).collect()}
    assert said == {"f": "a longer text", "h": "of h", "i": None}
    marks = spark.createDataFrame([("1", "UFUNCTION", "f", 2), ("2", "UCLASS", "f", 2), ("3", "UFUNCTION", "h", 1)], "annotation_id string, macro string, symbol_name string, declaration_line int")
    twin = spark.createDataFrame([symbol("h")], schemas.SYMBOL).withColumn("stable_usr", F.lit("h2"))
    status = {r.annotation_id: (r.status, r.stable_usr) for r in symbols.attach_annotations(merged.select(*twin.columns).unionByName(twin), marks).collect()}
    assert status == {"1": ("attached", "f"), "2": ("unmatched", None), "3": ("ambiguous", None)}


def edge(kind, a, b, line=1, confidence=1.0):
    return (kind, a, b, confidence, "r/a.h", line, 1)


def test_relation_index_counts(spark, some):
    merged, _ = symbols.merge_symbols(some)
    shards = spark.createDataFrame([edge("calls", "f", "h", confidence=0.5), edge("calls", "f", "h"), edge("calls", "f", "gone"), edge("inherits", "h", "i")], schemas.SYMBOL_EDGE)
    for rows in (shards, shards.orderBy(F.desc("dst_usr"))):
        edges, counts = graph.relation_index(rows, merged)
        assert {(e.edge_type, e.src_usr, e.dst_usr, e.confidence) for e in edges.collect()} == {("calls", "f", "h", 1.0), ("inherits", "h", "i", 1.0), ("owns", "f", "h", 1.0)}
        assert tuple(counts.first()) == (4, 1, 1, 1, 1)
    with pytest.raises(ValidationError):
        graph.relation_index(spark.createDataFrame([edge("calls", "f", "h", confidence=2.0)], schemas.SYMBOL_EDGE), merged)


def test_traversals_end_in_cycles(spark):
    edges = spark.createDataFrame([edge("calls", a, b) for a, b in ("ab", "bc", "ca", "cd")] + [edge("inherits", "d", "a")], schemas.SYMBOL_EDGE)
    reached = lambda df: {r.node: r.depth for r in df.collect()}
    assert reached(graph.trace_calls(edges, "a", 8)) == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert reached(graph.trace_calls(edges, "a", 1)) == {"a": 0, "b": 1}
    assert reached(graph.trace_calls(edges, "d", 2, direction="in")) == {"d": 0, "c": 1, "b": 2}
    assert len(reached(graph.trace_calls(edges, "a", 8, nodes=2))) == 3
    assert reached(graph.derived_types(edges, "a")) == {"a": 0, "d": 1}


def test_token_estimates(spark):
    rows = spark.createDataFrame([("",), ("void Run();",), ("中文注释",), (" ",), ("a b﻿c😀",)], "t string")
    assert [r[0] for r in rows.select(tx.token_estimate(F.col("t"))).collect()] == [0, 5, 4, 1, 4]


def test_slices_count_utf16_units(spark):
    rows = spark.createDataFrame([("int a;\n😀 = b;\n", 2, 3, 2, 8), ("abc", 1, 1, 9, 1), ("abc", 1, 3, 1, 2), (" x ", 1, 1, 1, 4)], "t string, a int, b int, c int, d int")
    assert [r[0] for r in rows.select(chunks.source_slice("t", "a", "b", "c", "d")).collect()] == ["= b;", None, None, "x"]


def test_pieces_keep_the_text_and_the_budgets():
    text = "alpha beta; " * 40 + "é" * 50
    parts = chunks.pieces(text, 64, 10)
    assert "".join(parts) == text and all(len(p.encode()) <= 64 for p in parts)
    assert chunks.pieces("a b", 64, 10) == ["a b"]
    cut = chunks.pieces("x" * 25 + " a b c", 10, 2)  # what is left of a cut lexeme counts as one
    assert cut == ["x" * 10, "x" * 10, "xxxxx a ", "b c"]


def test_chunks_of_locations_and_documentation(spark):
    rows = spark.createDataFrame([symbol("f", 1, doc="Says.", end=11), symbol("g", 7)], schemas.SYMBOL)
    sources = spark.createDataFrame([("r/a.h", "int f(){}; \nrest")], "file string, text string")
    made, counts = chunks.make_chunks(rows, sources)
    got = {(r.symbol_usr, r.chunk_kind): r for r in made.collect()}
    assert {k: r.text for k, r in got.items()} == {("f", "definition"): "int f(){};", ("f", "documentation"): "N::f\nSays."}
    assert all(r.content_hash == hashlib.sha256(r.text.encode()).hexdigest() and len(r.stable_key) == 64 for r in got.values())
    assert tuple(counts.first()) == (2, 0, 1, 0)
    dotted = chunks.make_chunks(rows, spark.createDataFrame([("r/./x/../a.h", "int f(){}; \nrest")], "file string, text string"))[0].collect()
    assert {r.stable_key for r in dotted} == {r.stable_key for r in got.values()} and {r.file for r in dotted} == {"r/./x/../a.h"}
    twice = spark.createDataFrame([symbol("f", 1, end=11), symbol("f", 1, end=11)], schemas.SYMBOL)
    with pytest.raises(ValidationError, match="stable_key"):
        chunks.make_chunks(twice, sources)
    again = {r.stable_key for r in chunks.make_chunks(rows.orderBy(F.desc("stable_usr")), sources)[0].collect()}
    assert again == {r.stable_key for r in got.values()}


def provider(texts, key):
    return [[float(len(t)), 1.0] for t in texts]


def test_each_content_is_embedded_once(spark):
    rows = spark.createDataFrame([("k1", "h1", "aa", 1), ("k2", "h1", "aa", 1), ("k3", "h2", "bbbb", 1)], "stable_key string, content_hash string, text string, token_count int")
    cache = spark.createDataFrame([("h2", [9.0, 9.0])], "content_hash string, embedding array<float>")
    got = {r.stable_key: list(r.embedding) for r in embedding.embed_chunks(rows, cache, provider, ("p", "m", 2)).collect()}
    assert got == {"k1": [2.0, 1.0], "k2": [2.0, 1.0], "k3": [9.0, 9.0]}
    with pytest.raises(Exception, match="pair off"):
        embedding.embed(rows, provider, 3).collect()
    assert [len(b) for b in embedding.batches([("h", "x", 20_000)] * 3)] == [1, 1, 1] and [len(b) for b in embedding.batches([("h", "x", 1)] * 65)] == [64, 1]


def test_generations_move_in_order(spark, tmp_path):
    book, root = generations.Registry(str(tmp_path / "state.json")), str(tmp_path)
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    none = spark.createDataFrame([], "rule string, n long")
    for name in ("g1", "g2"):
        book.stage(name, "p")
        now = book.record(name, "chunks", rows, root)
        assert book.record(name, "chunks", rows.orderBy(F.desc("id")), root) == now and now.counts == {"chunks": 2}
        with pytest.raises(generations.StateError, match="dirty"):
            book.record(name, "chunks", rows.where("id = 1"), root)
        with pytest.raises(generations.StateError):
            book.publish(name, now.publication_version)
        ready = book.validate(name, now.publication_version, none)
        with pytest.raises(generations.StateError):
            book.publish(name, ready.publication_version - 1)
        book.publish(name, ready.publication_version)
    assert book.active("p").id == "g2" and book.load()["g1"].status == "superseded"
    book.rollback("g1", book.load()["g1"].publication_version)
    assert book.active("p").id == "g1"
    book.claim("g2", book.load()["g2"].publication_version, "t")
    with pytest.raises(generations.StateError):
        book.forget("g2", "other")
    book.forget("g2", "t")
    assert set(book.load()) == {"g1"}
    bad = book.stage("g3", "p")
    with pytest.raises(ValidationError, match="chunk without file: 3"):
        book.validate("g3", bad.publication_version, spark.createDataFrame([("chunk without file", 3)], "rule string, n long"))
    assert book.load()["g3"].status == "failed"


def test_two_drivers_do_not_both_step(spark, tmp_path):
    for session in (None, spark):
        path = str(tmp_path / f"states-{session is not None}")
        one, two = generations.Registry(path, session), generations.Registry(path, session)
        one.stage("g", "p")
        rows = two.load()
        one.load()
        one._save(rows | {"h": generations.Generation("h", "p")})
        with pytest.raises(generations.StateError, match="moved the states on"):
            two._save(rows | {"i": generations.Generation("i", "p")})
        assert set(two.load()) == {"g", "h"} == set(one.load())
        two._step("g", 1, ("building",), writing=f"chunks:{two.owner}")
        with pytest.raises(generations.StateError, match="another driver writes chunks"):
            one.record("g", "chunks", spark.range(3), str(tmp_path))
        assert one.record("g", "chunks", spark.range(3), f"{tmp_path}/{session is not None}", take_over=True).counts == {"chunks": 3}


def test_documentation_that_disagrees_raises(spark):
    rows = spark.createDataFrame([("f", "N::f", "function", "short")], "stable_usr string, qualified_name string, kind string, documentation string")
    doc = lambda name, kind: spark.createDataFrame([(hashlib.sha1(b"f").hexdigest(), "a longer text", name, kind, ["T"])], "documentation_id string, text string, qualified_name string, kind string, template_parameters array<string>")
    got = symbols.attach_documentation(rows, doc("N::f", "function")).first()
    assert got.documentation == "a longer text" and got.template_parameters == ["T"]
    for name, kind in (("N::g", "function"), ("N::f", "class")):
        with pytest.raises(ValidationError):
            symbols.attach_documentation(rows, doc(name, kind))
    two = doc("N::f", "function").unionByName(doc("N::f", "function"))
    with pytest.raises(ValidationError):
        symbols.attach_documentation(rows, two)


def test_two_annotations_at_one_symbol_raise(spark):
    rows = spark.createDataFrame([("f",)], "stable_usr string")
    marks = lambda n: spark.createDataFrame([(i, "UFUNCTION", "attached", "f", ["BlueprintPure"]) for i in range(n)], "annotation_id int, macro string, status string, stable_usr string, specifiers array<string>")
    assert symbols.annotated(rows, marks(1)).first().exposure == "pure"
    with pytest.raises(ValidationError):
        symbols.annotated(rows, marks(2))


def test_relation_hash_ignores_order(spark):
    rows = spark.createDataFrame([Row(a=i, b=str(i)) for i in range(50)])
    one = evaluation.relation_hash(rows, "a", "b").first()
    assert one == evaluation.relation_hash(rows.orderBy(F.desc("a")).repartition(7), "a", "b").first()
    assert one.payload_hash != evaluation.relation_hash(rows.where("a > 0"), "a", "b").first().payload_hash


def test_uniqueness_raises(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    require_unique(rows.where("a = 2"), "a", "b")
    with pytest.raises(ValidationError):
        require_unique(rows, "a", "b")
