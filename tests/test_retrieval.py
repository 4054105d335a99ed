"""Signals, access and tools over a small index, and hybrid retrieval from end to end."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.operators import acl, signals
from lodestone.plans import hybrid, tools

CHUNKS = [
    ("k1", "f1", "u1", "N::run", "run", "definition", "run the fast engine", "h1", "r1", "src/a.c"), ("k2", "f2", "u2", "N::walk", "walk", "declaration", "walk the slow engine the engine", "h2", "r1", "src/b.c"),
    ("k3", "f3", "u3", "N::hide", "hide", "definition", "hide the fast engine", "h3", "r1", "src2/c.c"), ("k4", "f4", None, None, None, "file_context", "nothing here", "h4", "r2", "d.c"),
]


@pytest.fixture(scope="module")
def index(spark):
    chunks = spark.createDataFrame(CHUNKS, "stable_key string, file_id string, stable_usr string, qualified_name string, name string, chunk_kind string, text string, content_hash string, repository_id string, path string")
    edges = spark.createDataFrame([("calls", "u1", "u2", 0.9, "r1", "src/a.c"), ("calls", "u1", "u3", 0.8, None, None), ("calls", "u2", "u1", 0.7, "r1", "src2/x.c")], "edge_type string, src_usr string, dst_usr string, confidence double, evidence_repository_id string, evidence_path string")
    vectors = [("h1", [1.0, 0.0]), ("h2", [0.6, 0.8]), ("h3", [1.0, 0.0]), ("h4", [0.0, 0.0])]
    embeddings = spark.createDataFrame([(h, "p", "m", 2, v) for h, v in vectors], "content_hash string, provider string, model string, dimensions int, embedding array<float>")
    return hybrid.Index(chunks, signals.postings(chunks), edges, embeddings)


@pytest.fixture(scope="module")
def may(spark):
    return acl.acl_table(spark, [("r1", "src"), ("R2", "")])


def keys(df):
    return [r.stable_key for r in df.collect()]


def test_prefixes_end_at_slashes(index, may):
    assert sorted(keys(acl.visible(index.chunks, may))) == ["k1", "k2", "k4"]


@pytest.mark.parametrize("bad", [[], [("r", "/a")], [("r", "a/../b")], [("r", "a\\b")], [("r", "a"), ("r", "a/")]])
def test_bad_access_lists_raise(spark, bad):
    with pytest.raises(ValueError):
        acl.acl_table(spark, bad)


def test_exact_and_full_text(index, may):
    assert [(r.stable_key, r.score) for r in signals.exact_symbols(index.chunks, may, "u1").collect()] == [("k1", 1.0)]
    assert [(r.stable_key, r.score) for r in signals.exact_symbols(index.chunks, may, " N::walk ").collect()] == [("k2", 0.95)]
    assert keys(signals.fts_chunks(index.postings, index.chunks, may, "Engine the")) == ["k2", "k1"]  # two spans beat one
    assert keys(signals.fts_chunks(index.postings, index.chunks, may, "fast absent")) == []
    with pytest.raises(ValueError):
        signals.exact_symbols(index.chunks, may, "a\x00b")


def test_vectors_of_one_profile(index, may):
    got = signals.vector_chunks(index.embeddings, index.chunks, may, ("p", "m", 2), [1.0, 0.0]).collect()
    assert [(r.stable_key, round(r.score, 6)) for r in got] == [("k1", 1.0), ("k2", 0.6)]
    for bad in ([0.0, 0.0], [float("nan"), 1.0], [1.0]):
        with pytest.raises(ValueError):
            signals.vector_chunks(index.embeddings, index.chunks, may, ("p", "m", 2), bad)


def test_graph_hides_what_is_not_visible(index, may):
    assert keys(signals.graph_signals(index.edges, index.chunks, may, "u1")) == ["k2"]  # u3's chunk and the edge from src2 are not
    assert keys(signals.graph_signals(index.edges, index.chunks, may, "u3")) == []


def test_scope_fails_closed(spark):
    rows = spark.createDataFrame([("g", "p", "active"), ("old", "p", "superseded")], "id string, project_id string, status string")
    projects = spark.createDataFrame([("p", "active")], "id string, status string")
    assert signals.active_scope(rows, projects, "p", "g") == "g"
    for bad in (("p", "old"), ("q", "g")):
        with pytest.raises(LookupError):
            signals.active_scope(rows, projects, *bad)


def test_hybrid_retrieval(spark, index, may):
    report = hybrid.retrieve(index, may, "run", embedding=[1.0, 0.0], profile=("p", "m", 2), anchor="u1")
    rows = sorted(report.hits.collect(), key=lambda r: r["rank"])
    assert report.degraded == [] and [r.chunk_key for r in rows] == ["k1", "k2"]
    assert [e.source for e in rows[0].evidence] == ["exact", "fts", "vector"]
    broken = hybrid.retrieve(index, may, "run", embedding=[1.0], profile=("p", "m", 2))
    assert broken.degraded == ["vector"] and [r.chunk_key for r in broken.hits.collect()] == ["k1"]
    turned = hybrid.retrieve(index, may, "the engine", scores=lambda df: df.select("chunk_key", F.when(F.col("chunk_key") == "k1", 0.9).otherwise(0.1).alias("score")))
    assert [r.chunk_key for r in sorted(turned.hits.collect(), key=lambda r: r["rank"])] == ["k1", "k2"]


def test_longest_prefix_and_roles(spark):
    rows = spark.createDataFrame([(1, "a/b/c"), (2, "ab"), (3, "a")], "id int, path string")
    rules = spark.createDataFrame([("a", "x"), ("a/b", "y")], "prefix string, value string")
    got = {r.id: (r.prefix, r.value) for r in acl.longest_prefix(rows, rules, "id", "path", "prefix", "value").collect()}
    assert got == {1: ("a/b", "y"), 2: (None, None), 3: ("a", "x")}
    grants = spark.createDataFrame([("user", "u", "viewer"), ("team", "t", "maintainer"), ("user", "v", "admin")], "principal_type string, principal_id string, role string")
    members = spark.createDataFrame([("u", "t")], "user_id string, team_id string")
    assert {r.user_id: r.role for r in acl.strongest_role(grants, members).collect()} == {"u": "maintainer", "v": "admin"}


def test_probes_and_freshness(spark):
    probes = spark.createDataFrame([("a", None), ("b", "E170001: no"), ("c", "timeout")], "path string, error string")
    assert {r.path: (r.access, r.complete) for r in acl.captured_access(probes).collect()} == {"a": ("read", True), "b": ("none", True), "c": ("indeterminate", False)}
    t = dt.datetime(2024, 1, 1)
    shots = spark.createDataFrame([("new", t, t + dt.timedelta(hours=1)), ("old", t - dt.timedelta(hours=2), t + dt.timedelta(hours=1)), ("over", t, t)], "id string, captured_at timestamp, expires_at timestamp")
    assert [r.id for r in acl.fresh(shots, F.lit("2024-01-01").cast("timestamp"), 600).collect()] == ["new"]


def test_tools(spark, index, may):
    files = spark.createDataFrame([("r1", "src/a.c", "one\ntwo\nthree"), ("r1", "src2/c.c", "no")], "repository_id string, path string, text string")
    assert tools.read_file_excerpt(files, may, "r1", "src/a.c", 2, 3).first().excerpt == "two\nthree"
    assert tools.read_file_excerpt(files, may, "r1", "src2/c.c", 1, 1).isEmpty()
    assert keys(tools.get_symbol(index.chunks, may, "u1")) == ["k1"] and keys(tools.get_symbol(index.chunks, may, "u3")) == []
    assert sorted(keys(tools.narrowed(index.chunks, ["r1"], ["definition"]))) == ["k1", "k3"]
    assert [r.src_usr for r in tools.find_references(index.edges.withColumns({"file": F.lit("a"), "line": F.lit(1)}), "u1").collect()] == ["u2"]
    assert keys(tools.keyset_page(index.chunks, "stable_key", "k1", 2)) == ["k2", "k3"]


def test_cursors_are_bound():
    cursor = tools.Cursor(b"s" * 32)
    token = cursor.encode("k2", "search", "ann", "q", now=100.0)
    assert cursor.decode(token, "search", "ann", "q", now=399.0) == "k2"
    for args in (("search", "bob", "q", 100.0), ("other", "ann", "q", 100.0), ("search", "ann", "q", 401.0)):
        with pytest.raises(ValueError):
            cursor.decode(token, *args)
    with pytest.raises(ValueError):
        cursor.decode("A" + token[1:], "search", "ann", "q", now=100.0)


def test_nearest_to_a_stored_vector(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [-1.0, 0.0]), (8, [None, 1.0]), (9, []), (2, [0.6, 0.8])]
    rows = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    asked = rows.where("id = 3").select(F.col("id").alias("asked"), "embedding")
    got = signals.vector_topk_of(rows, asked, "id").collect()
    assert [(r.id, r.asked, round(r.score, 6)) for r in got] == [(1, 3, 1.0), (3, 3, 1.0), (2, 3, 0.6), (2, 3, 0.6), (7, 3, 0.0)]
    clash = rows.where("id = 3").withColumn("score", F.lit(5.0))  # names of the rows and of the result are the rows' and the result's
    assert [r.id for r in signals.vector_topk_of(rows, clash, "id", limit=2).collect()] == [1, 3]
    assert signals.vector_topk_of(rows, clash, "id").columns == ["id", "embedding", "distance", "score"]
    assert signals.vector_topk_of(rows.limit(0), asked, "id").count() == 0
    for some in (asked.limit(0), asked.unionByName(asked)):
        with pytest.raises(ValueError, match="one row"):
            signals.vector_topk_of(rows, some, "id")
    assert signals.vector_topk_of(rows, rows.where("id = 5"), "id").count() == 0
