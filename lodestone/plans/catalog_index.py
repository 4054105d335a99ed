"""More of the library's operators on the driver's tables: what builds, stores and serves an index, with the same SQL rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import acl as acl_ops
from lodestone.operators import chunks, embedding, evaluation, generations, graph, persist, signals, symbols
from lodestone.plans import hybrid, tools
from lodestone.plans.catalog import query
from lodestone.sources import extraction
from lodestone.storage import dealt, stash, table
from lodestone.streaming import leases

NOW, NOW_SQL = "2024-01-15", "TIMESTAMP '2024-01-15'"


def _now():
    return F.lit(NOW).cast("timestamp")


# Index rows


@query("""
SELECT l_orderkey || '-' || l_linenumber AS stable_key, o_custkey AS repository_id, o_orderstatus AS path, p_name AS qualified_name, p_type AS symbol_kind
FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 7 <> 0 JOIN customer ON c_custkey = o_custkey AND c_mktsegment <> 'MACHINERY'
LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 WHERE l_returnflag = 'R'""")
def joined_index(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as chunks, parts as their symbols, orders as files, customers as repositories; the return flag is the generation."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("generation_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("stable_key"), F.col("l_partkey").alias("symbol_usr"), F.col("l_orderkey").alias("file_id"))
    named = table(spark, sf, "part").where("p_size > 10").select(F.lit("R").alias("generation_id"), F.col("p_partkey").alias("stable_usr"), F.col("p_name").alias("qualified_name"), F.col("p_brand").alias("name"), F.col("p_type").alias("kind"))
    files = table(spark, sf, "orders").where("o_orderkey % 7 <> 0").select(F.lit("R").alias("generation_id"), F.col("o_orderkey").alias("file_id"), F.col("o_custkey").alias("repository_id"), F.col("o_orderstatus").alias("path"))
    repositories = table(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("id"))
    return hybrid.joined_chunks(rows, named, files, repositories, "R").select("stable_key", "repository_id", "path", "qualified_name", "symbol_kind")


@query("""
WITH d AS (SELECT p_partkey, upper(sha1('u' || p_partkey)) AS id, p_comment FROM (SELECT p_partkey, p_name || ' ' || p_type AS p_comment FROM part WHERE p_partkey % 3 = 0))
SELECT 'u' || part.p_partkey AS stable_usr, CASE WHEN length(d.p_comment) > length(p_type || ' of ' || p_brand) THEN d.p_comment ELSE p_type || ' of ' || p_brand END AS documentation, d.id AS documentation_id
FROM part LEFT JOIN d USING (p_partkey)""")
def documentation_attach(spark, sf):
    part = table(spark, sf, "part")
    usr = F.concat(F.lit("u"), "p_partkey")
    named = part.select(usr.alias("stable_usr"), F.col("p_name").alias("qualified_name"), F.col("p_brand").alias("kind"), F.concat("p_type", F.lit(" of "), "p_brand").alias("documentation"))
    docs = part.where("p_partkey % 3 = 0").select(F.sha1(usr.cast("binary")).alias("documentation_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.col("p_name").alias("qualified_name"), F.col("p_brand").alias("kind"))
    return symbols.attach_documentation(named, docs).select("stable_usr", "documentation", "documentation_id")


@query("SELECT upper(sha1('u' || p_partkey)) AS documentation_id FROM part WHERE p_partkey % 3 = 0 AND p_size <= 25")
def documentation_unmatched(spark, sf):
    part = table(spark, sf, "part")
    usr = F.concat(F.lit("u"), "p_partkey")
    docs = part.where("p_partkey % 3 = 0").select(F.sha1(usr.cast("binary")).alias("documentation_id"))
    return symbols.unmatched_documentation(part.where("p_size > 25").select(usr.alias("stable_usr")), docs)


_PLACES_SQL = """
s AS (SELECT 'u' || p_partkey AS stable_usr, 'name' || p_partkey % 900 AS symbol_name, CASE p_size % 3 WHEN 0 THEN 'UCLASS' WHEN 1 THEN 'UFUNCTION' ELSE 'UPROPERTY' END AS macro, p_size AS declaration_line FROM part),
m AS (SELECT p_partkey AS annotation_id, 'name' || p_partkey % 900 AS symbol_name, CASE p_size % 3 WHEN 0 THEN 'UCLASS' WHEN 1 THEN 'UFUNCTION' ELSE 'UPROPERTY' END AS macro,
  CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS declaration_line, p_partkey % 4 AS spec FROM part WHERE p_partkey > 100),
j AS (SELECT annotation_id, count(stable_usr) AS n, min(stable_usr) AS usr, any_value(macro) AS macro, any_value(spec) AS spec FROM m LEFT JOIN s USING (symbol_name, macro, declaration_line) GROUP BY annotation_id)
"""


def _annotations(spark, sf):
    part = table(spark, sf, "part")
    name, macro = F.concat(F.lit("name"), F.col("p_partkey") % 900), F.element_at(F.array(*map(F.lit, ("UCLASS", "UFUNCTION", "UPROPERTY"))), F.col("p_size") % 3 + 1)
    kind = F.element_at(F.array(*map(F.lit, ("class", "method", "field"))), F.col("p_size") % 3 + 1)
    place = F.array(F.struct(F.lit("definition").alias("kind"), F.col("p_size").alias("start_line")))
    named = part.select(F.concat(F.lit("u"), "p_partkey").alias("stable_usr"), F.concat(F.lit("a::"), name).alias("qualified_name"), kind.alias("kind"), place.alias("locations"))
    specifiers = F.element_at(F.array(*[F.array(*map(F.lit, x)) for x in (["Blueprintable"], ["BlueprintCallable", "Exec"], ["BlueprintPure", "BlueprintCallable"], ["EditAnywhere", "BlueprintReadOnly"])]), (F.col("p_partkey") % 4 + 1).cast("int"))
    line = F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))
    marks = part.where("p_partkey > 100").select(F.col("p_partkey").alias("annotation_id"), macro.alias("macro"), name.alias("symbol_name"), line.alias("declaration_line"), specifiers.alias("specifiers"))
    return named, symbols.attach_annotations(named, marks)


@query(f"WITH {_PLACES_SQL} SELECT annotation_id, CASE WHEN n = 0 THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'attached' END AS status, CASE WHEN n = 1 THEN usr END AS stable_usr FROM j")
def annotation_status(spark, sf):
    return _annotations(spark, sf)[1].select("annotation_id", "status", "stable_usr")


@query(f"""
WITH {_PLACES_SQL}, one AS (SELECT usr AS stable_usr, min(annotation_id) AS annotation_id FROM j WHERE n = 1 GROUP BY usr)
SELECT stable_usr, coalesce(CASE WHEN macro = 'UCLASS' AND spec = 0 THEN 'type' WHEN macro = 'UPROPERTY' AND spec = 3 THEN 'property' WHEN macro = 'UFUNCTION' AND spec = 2 THEN 'pure' WHEN macro = 'UFUNCTION' AND spec = 1 THEN 'callable' END, 'none') AS exposure
FROM s LEFT JOIN (SELECT stable_usr, spec FROM one JOIN j USING (annotation_id)) USING (stable_usr)""")
def annotation_exposure(spark, sf):
    named, marks = _annotations(spark, sf)
    first = marks.where("status = 'attached'").groupBy("stable_usr").agg(F.min("annotation_id").alias("annotation_id"))
    one = marks.join(first.select("annotation_id"), "annotation_id", "left_semi")  # two at one symbol would raise
    return symbols.annotated(named, one).select("stable_usr", "exposure")


@query("SELECT DISTINCT l_partkey % 50 AS src_file, l_suppkey % 40 AS dst_file, l_linenumber AS line, l_quantity::INTEGER AS \"column\" FROM lineitem")
def include_merge(spark, sf):
    return graph.merge_includes(table(spark, sf, "lineitem").select((F.col("l_partkey") % 50).alias("src_file"), (F.col("l_suppkey") % 40).alias("dst_file"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("column")))


@query("""
SELECT 'calls' AS edge_type, l_partkey AS src_usr, l_suppkey AS dst_usr, l_linenumber AS line, CASE WHEN l_linenumber > 2 THEN 1000 + l_suppkey END AS file_id, max(l_discount) AS confidence FROM lineitem GROUP BY ALL""")
def evidence_resolution(spark, sf):
    path = F.when(F.col("l_linenumber") > 2, F.concat(F.lit("src/"), "l_suppkey"))
    edges = table(spark, sf, "lineitem").select(F.lit("calls").alias("edge_type"), F.col("l_partkey").alias("src_usr"), F.col("l_suppkey").alias("dst_usr"), path.alias("file"), F.col("l_linenumber").alias("line"), F.col("l_discount").alias("confidence"))
    files = table(spark, sf, "supplier").select(F.concat(F.lit("src/"), "s_suppkey").alias("path"), (F.col("s_suppkey") + 1000).alias("file_id"))
    no_pairs = files.select(F.col("path").alias("src_file"), F.col("path").alias("dst_file")).limit(0)
    return persist.relation_rows(edges, no_pairs, files)[0]


@query("""
SELECT c.s_suppkey AS stable_usr, o.s_suppkey AS owner_usr FROM supplier c LEFT JOIN supplier o ON o.s_suppkey = c.s_suppkey // 2 AND o.s_suppkey % 3 <> 0 AND o.s_suppkey <> 0 WHERE c.s_suppkey % 3 <> 0""")
def owner_resolution(spark, sf):
    own = table(spark, sf, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("stable_usr"), F.floor(F.col("s_suppkey") / 2).alias("owner_usr"), F.array(F.struct(F.lit("f").alias("file"), F.lit(1).alias("start_line"))).alias("locations"))
    return persist.symbol_rows(own, spark.createDataFrame([("f", 1)], "path string, file_id int"))[0].select("stable_usr", "owner_usr")


@query("SELECT doc_id, sha256(text) AS content_hash, len(text)::DOUBLE AS x, CASE WHEN first % 2 = 0 THEN 1.0 ELSE 0.5 END AS y FROM (SELECT min(doc_id) OVER (PARTITION BY text) AS first, * FROM documents) WHERE text <> ''")
def embedded_chunks(spark, sf):
    """Texts whose first document has an even id are in the cache with (length, 1); the provider answers (length, 0.5)."""
    docs = table(spark, sf, "documents").where("text <> ''").select("doc_id", "text", tx.content_hash(F.col("text")).alias("content_hash"), tx.token_estimate(F.col("text")).alias("token_count"))
    docs = stash(docs, "texts")
    even = docs.groupBy("content_hash").agg(F.min("doc_id").alias("first"), F.min(F.length("text")).alias("n")).where("first % 2 = 0")
    cache = even.select("content_hash", F.array(F.col("n").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    out = embedding.embed_chunks(docs, cache, lambda texts, key: [[float(len(t)), 0.5] for t in texts], ("p", "m", 2))
    return out.select("doc_id", "content_hash", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query("SELECT label AS content_hash, vec_id AS chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id % 17, vec_id) AS k FROM embeddings WHERE vec_id % 3 = 1) WHERE k = 1")
def cached_vectors(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").alias("content_hash"), F.lit("p").alias("provider"), F.concat(F.lit("m"), F.col("vec_id") % 3).alias("model"), F.size("embedding").alias("dimensions"), (F.col("vec_id") % 17).alias("created_at"), F.col("vec_id").alias("chunk_id"))
    return embedding.cached_vectors(rows, "p", "m1", 64).select("content_hash", "chunk_id")


# Store


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'F' THEN 'changed' ELSE o_orderstatus END AS o_orderstatus FROM orders UNION ALL SELECT -o_orderkey - 1, 'new' FROM orders WHERE o_orderkey % 100 = 0")
def guarded_upsert(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    changes = rows.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("changed").alias("o_orderstatus")).unionByName(rows.where("o_orderkey % 100 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey"), F.lit("new").alias("o_orderstatus")))
    return persist.upsert(rows, changes, "o_orderkey", F.col("old.o_orderstatus") != "F")


@query("SELECT count(*) AS n, sum(octet_length(encode(text))) AS bytes, true AS few_rows, true AS few_bytes, true AS full FROM documents")
def statement_batches(spark, sf):
    """What the batches of a sink hold together: every row once, whole; and that they keep their limits, and use them."""
    batches = persist.statement_batches(table(spark, sf, "documents").where("text is not null").select("doc_id", "text"), 100, 4 << 20)
    back = batches.select(F.explode(F.from_json("payload", "array<struct<doc_id:long,text:string>>")).alias("r"))
    kept = batches.agg((F.max("rows") <= 100).alias("few_rows"), (F.max(F.octet_length("payload")) <= 4 << 20).alias("few_bytes"), (F.max("rows") == 100).alias("full"))
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("r.text")).alias("bytes")).crossJoin(kept)  # each is one row


@query("""
SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(l_orderkey) AS lines FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def left_counts(spark, sf):
    chain = [("orders", table(spark, sf, "orders"), "o_custkey", "o_orderkey"), ("lines", table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")]
    return generations.left_counts(table(spark, sf, "customer"), "c_custkey", chain)


@query("""
SELECT 'chunk without embedding' AS rule, count(*) AS n FROM lineitem WHERE l_partkey > 100 HAVING n > 0
UNION ALL SELECT 'chunk without file', count(*) AS n FROM lineitem WHERE l_orderkey % 2 <> 0 HAVING n > 0
UNION ALL SELECT 'edge without target', count(*) AS n FROM supplier WHERE s_nationkey <> 3 HAVING n > 0""")
def generation_faults(spark, sf):
    li, supplier = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    keys = table(spark, sf, "part").select(F.col("p_partkey").alias("content_hash"))
    rows = li.select(F.col("l_partkey").alias("content_hash"), F.col("l_orderkey").alias("file"), F.lit(None).cast("long").alias("symbol_usr"))
    edges = supplier.select(F.col("s_suppkey").alias("src_usr"), F.when(F.col("s_nationkey") == 3, F.col("s_suppkey")).otherwise(-F.col("s_suppkey") - 1).alias("dst_usr"))
    named = supplier.select(F.col("s_suppkey").alias("stable_usr"))
    files = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("file_id"))
    return generations.completeness(rows, keys.where("content_hash <= 100"), edges, named, named, files)


@query("""
WITH d AS (SELECT sha256(o_custkey || chr(31) || o_orderkey || chr(31) || o_orderstatus) AS d FROM orders)
SELECT count(*) AS n, sha256(count(*) || ':' || sum(('0x' || d[1:15])::BIGINT) || ':' || sum(('0x' || d[16:30])::BIGINT) || ':' || sum(('0x' || d[31:45])::BIGINT) || ':' || sum(('0x' || d[46:60])::BIGINT)) AS payload_hash FROM d""")
def relation_hash(spark, sf):
    return evaluation.relation_hash(table(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, count(*) AS count FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    from lodestone.validate import duplicates

    return duplicates(table(spark, sf, "orders"), "o_custkey")


# Access and tools


@query("""
WITH p AS (SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1) END AS path, string_split(regexp_extract(url, '://([^/?#]*)', 1), '.')[-1] AS repository_id FROM pages)
SELECT page_id, path FROM p WHERE path IS NULL OR (repository_id = 'net' AND (path = 'en' OR starts_with(path, 'en/'))) OR repository_id = 'com'""")
def acl_optional(spark, sf):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    path = F.when(F.col("page_id") % 4 != 0, F.regexp_extract("url", "://[^/?#]*/?([^?#]*)", 1))
    rows = table(spark, sf, "pages").select("page_id", F.element_at(F.split(host, "\\."), -1).alias("repository_id"), path.alias("path"))
    return acl_ops.visible(rows, acl_ops.acl_table(spark, [("net", "en"), ("com", "")]), optional=True).select("page_id", "path")


@query(f"SELECT event_id FROM events WHERE ts + INTERVAL 6 HOUR > {NOW_SQL} AND ts <= {NOW_SQL} AND epoch({NOW_SQL}) - floor(epoch(ts)) <= 18000")
def fresh_snapshots(spark, sf):
    shots = table(spark, sf, "events").select("event_id", F.col("ts").alias("captured_at"), (F.col("ts") + F.expr("INTERVAL 6 HOUR")).alias("expires_at"))
    return acl_ops.fresh(shots, _now(), 18_000).select("event_id")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'none' WHEN 'purchase' THEN 'indeterminate' ELSE 'read' END AS access, event_type <> 'purchase' AS complete FROM events")
def probe_access(spark, sf):
    error = F.when(F.col("event_type") == "error", "svn: E170001: no").when(F.col("event_type") == "purchase", "timed out")
    return acl_ops.captured_access(table(spark, sf, "events").select("event_id", error.alias("error"))).select("event_id", "access", "complete")


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') AND lang IN ('en', 'fr') AND doc_id % 5 = 2 AND n_chars % 2 = 1")
def code_search_filters(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("repository_id"), F.col("lang").alias("chunk_kind"), F.concat(F.lit("m"), F.col("doc_id") % 5).alias("module"), F.concat(F.lit("r"), F.col("n_chars") % 2).alias("revision"))
    return tools.narrowed(rows, ["src1", "src2"], ["en", "fr"], "m2", "r1").select("doc_id")


@query("SELECT src_usr, dst_usr, edge_type, confidence FROM (SELECT l_partkey AS src_usr, l_suppkey AS dst_usr, l_returnflag AS edge_type, max(l_discount) AS confidence FROM lineitem GROUP BY ALL) WHERE dst_usr = 7 ORDER BY confidence DESC, edge_type, src_usr, dst_usr LIMIT 50")
def find_references(spark, sf):
    none = F.lit(None).cast("int")
    edges = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src_usr"), F.col("l_suppkey").alias("dst_usr"), F.col("l_returnflag").alias("edge_type"), F.col("l_discount").alias("confidence"))
    merged = graph.merge_edges(edges, ["src_usr", "dst_usr", "edge_type"]).withColumns({"file": none, "line": none})
    return tools.find_references(merged, 7, limit=50).select("src_usr", "dst_usr", "edge_type", "confidence")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark, sf):
    return tools.keyset_page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 1000, 100)


@query("""
SELECT id, status, published_at, (SELECT count(*) FROM lineitem WHERE l_orderkey = id AND l_returnflag = 'N') AS open_failures
FROM (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'active' ELSE 'failed' END AS status, o_orderdate AS published_at FROM orders WHERE o_custkey = 11) WHERE status = 'active'""")
def index_status(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "active").otherwise("failed")
    own = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), status.alias("status"), F.col("o_orderdate").alias("published_at"))
    failures = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("generation_id"), F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("resolved_at"))
    return tools.index_status(own, failures, 11)


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 1 ORDER BY c_name, c_custkey LIMIT 50")
def list_projects(spark, sf):
    customer = table(spark, sf, "customer")
    projects = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "active").otherwise("archived").alias("status"))
    roles = customer.select(F.col("c_custkey").alias("project_id"), F.when(F.col("c_nationkey") % 2 == 1, "viewer").otherwise("none").alias("role"))
    return tools.list_projects(projects, roles, 50).select("id", "name")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT >= 50")
def json_path(spark, sf):
    events = table(spark, sf, "events").withColumn("k", signals.json_at("props", "$.k", "long"))
    return events.where("k >= 50").select("event_id", "k")


@query("SELECT n_nationkey, n_name, want, n_regionkey IN (1, 3) AS chosen FROM nation JOIN (VALUES (3, 'c'), (7, 'a'), (99, 'z')) v(id, want) ON id = n_nationkey")
def json_parameters(spark, sf):
    asked = extraction.parameter_rows(spark, '[{"id": 3, "want": "c"}, {"id": 7, "want": "a"}, {"id": 99, "want": "z"}]', "id:int,want:string")
    chosen = extraction.parameter_values(spark, "[1, 3]", "int")  # both are a few rows, given as parameters
    return table(spark, sf, "nation").join(F.broadcast(asked), F.col("n_nationkey") == F.col("id")).join(F.broadcast(chosen), F.col("n_regionkey") == F.col("value"), "left").select("n_nationkey", "n_name", "want", F.col("value").isNotNull().alias("chosen"))


@query("""
WITH s AS (SELECT DISTINCT src_usr, dst_usr, confidence FROM (SELECT l_partkey AS src_usr, l_suppkey AS dst_usr, max(l_discount) AS confidence FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) WHERE src_usr = 5)
SELECT p_partkey AS stable_usr, confidence AS score FROM s JOIN part ON p_partkey = dst_usr WHERE p_size > 5 AND (SELECT p_size FROM part WHERE p_partkey = 5) > 5 ORDER BY score DESC, stable_usr LIMIT 100""")
def graph_signals(spark, sf):
    """Parts of more than size 5 are visible; the edges have no evidence of their own."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("stable_usr"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("stable_key"), F.lit("same").alias("qualified_name"), F.when(F.col("p_size") > 5, "all").otherwise("none").alias("repository_id"), F.lit("a").alias("path"))
    edges = table(spark, sf, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("src_usr"), F.col("l_suppkey").alias("dst_usr")).agg(F.max("l_discount").alias("confidence"))
    edges = edges.withColumns({"edge_type": F.lit("calls"), "evidence_repository_id": F.lit(None).cast("string"), "evidence_path": F.lit(None).cast("string")})
    return signals.graph_signals(edges, part, acl_ops.acl_table(spark, [("all", "")]), 5, direction="out", limit=100).select("stable_usr", "score")


# Leases

_JOBS_SQL = f"""
j AS (SELECT event_id AS job_id, CASE WHEN event_id % 3 = 0 THEN 'running' WHEN event_id % 3 = 1 THEN 'queued' ELSE 'succeeded' END AS status, event_id % 7 AS priority, (event_id % 4)::INTEGER AS attempt, 3 AS max_attempts,
  ts AS available_at, CASE WHEN event_id % 3 = 0 THEN 'a' || user_id % 50 END AS agent, CASE WHEN event_id % 3 = 0 THEN 't' || event_id END AS token, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 2 DAY END AS ends, ts FROM events)"""


def _jobs(spark, sf):
    running, held = F.col("event_id") % 3 == 0, lambda c: F.when(F.col("event_id") % 3 == 0, c)
    null = F.lit(None)
    return table(spark, sf, "events").select(
        F.col("event_id").alias("job_id"), F.when(running, "running").when(F.col("event_id") % 3 == 1, "queued").otherwise("succeeded").alias("status"), (F.col("event_id") % 7).alias("priority"), (F.col("event_id") % 4).cast("int").alias("attempt"),
        F.lit(3).alias("max_attempts"), F.col("ts").alias("available_at"), F.col("ts").alias("requested_at"), held(F.concat(F.lit("a"), F.col("user_id") % 50)).alias("lease_agent_id"), held(F.concat(F.lit("t"), "event_id")).alias("lease_token"),
        held(F.col("ts") + F.expr("INTERVAL 2 DAY")).alias("lease_expires_at"), held(F.col("ts")).alias("started_at"), null.cast("timestamp").alias("finished_at"), null.cast("timestamp").alias("cancellation_requested_at"),
        null.cast("string").alias("last_failure_agent_id"), null.cast("int").alias("last_failure_attempt"), null.cast("string").alias("last_error_code"), null.cast("boolean").alias("last_error_retryable"),
        F.when(F.col("event_id") % 3 == 2, F.concat(F.lit("a"), F.col("user_id") % 50)).alias("completion_agent_id"), F.when(F.col("event_id") % 3 == 2, (F.col("event_id") % 4).cast("int")).alias("completion_attempt"),
    )


@query(f"WITH {_JOBS_SQL} SELECT job_id FROM j WHERE status = 'queued' AND available_at <= {NOW_SQL} ORDER BY priority DESC, available_at, job_id LIMIT 1")
def queue_head(spark, sf):
    return leases.next_job(_jobs(spark, sf), _now()).select("job_id")


@query(f"""
WITH {_JOBS_SQL}, g AS (SELECT 'a' || i AS agent, i % 4 <> 0 AS able FROM range(0, 80) t(i) WHERE i % 7 <> 0),
h AS (SELECT agent, min((ts, job_id))[2] AS job_id FROM j JOIN g USING (agent) WHERE status = 'running' AND ends > {NOW_SQL} GROUP BY agent),
f AS (SELECT agent, row_number() OVER (ORDER BY agent) AS k FROM g WHERE able AND agent NOT IN (SELECT agent FROM h)),
q AS (SELECT job_id, row_number() OVER (ORDER BY priority DESC, available_at, job_id) AS k FROM j WHERE status = 'queued' AND available_at <= {NOW_SQL})
SELECT h.agent AS agent_id, job_id, attempt, token AS lease_token, ends AS lease_expires_at, true AS repeated FROM h JOIN j USING (job_id)
UNION ALL SELECT f.agent, job_id, attempt + 1, sha256('n' || chr(31) || job_id || chr(31) || (attempt + 1) || chr(31) || f.agent), {NOW_SQL} + INTERVAL 1 MINUTE, false FROM f JOIN q USING (k) JOIN j USING (job_id)""")
def lease_claim(spark, sf):
    """Agents a0 to a79 without every seventh ask; every fourth lacks a capability."""
    able = F.create_map(*[x for c in leases.NEEDED for x in (F.lit(c), F.col("id") % 4 != 0 if c == "clang-index" else F.lit(True))])
    agents = spark.range(80).where("id % 7 <> 0").select(F.concat(F.lit("a"), "id").alias("id"), F.lit("online").alias("status"), able.alias("capabilities"))
    return leases.claim(_jobs(spark, sf), agents, _now(), 60_000, "n")[1]


_REPORTS_SQL = f"""
r AS (SELECT job_id, CASE WHEN job_id % 5 = 0 THEN 'stranger' ELSE coalesce(agent, 'a' || (SELECT user_id % 50 FROM events WHERE event_id = job_id)) END AS who, attempt, coalesce(token, 'old') AS tok, CASE WHEN job_id % 2 = 0 THEN 'succeeded' ELSE 'failed' END AS outcome, job_id % 4 = 1 AS retryable, status, ends, agent FROM j),
o AS (SELECT *, CASE WHEN status = 'running' AND who = agent AND ends > {NOW_SQL} THEN 'applied' WHEN status = 'succeeded' AND outcome = 'succeeded' AND who <> 'stranger' THEN 'already_applied' ELSE 'lease_lost' END AS result FROM r)"""


def _reports(spark, sf):
    agent = F.when(F.col("event_id") % 5 == 0, "stranger").otherwise(F.concat(F.lit("a"), F.col("user_id") % 50))
    token = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("t"), "event_id")).otherwise("old")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("job_id"), agent.alias("agent_id"), (F.col("event_id") % 4).cast("int").alias("attempt"), token.alias("lease_token"),
        F.when(F.col("event_id") % 2 == 0, "succeeded").otherwise("failed").alias("outcome"), (F.col("event_id") % 4 == 1).alias("retryable"),
    )


@query(f"WITH {_JOBS_SQL}, {_REPORTS_SQL} SELECT job_id, who AS agent_id, result FROM o")
def lease_reports(spark, sf):
    return leases.outcomes(_jobs(spark, sf), _reports(spark, sf), _now()).select("job_id", "agent_id", "result")


@query(f"""
WITH {_JOBS_SQL}, {_REPORTS_SQL}
SELECT job_id, CASE WHEN result <> 'applied' THEN status WHEN outcome = 'succeeded' THEN 'succeeded' WHEN retryable AND attempt < 3 THEN 'queued' ELSE 'failed' END AS status,
  CASE WHEN result = 'applied' THEN NULL ELSE agent END AS lease_agent_id, CASE WHEN result = 'applied' AND NOT (outcome = 'failed' AND retryable AND attempt < 3) THEN {NOW_SQL} END AS finished_at,
  CASE WHEN result = 'applied' AND outcome = 'failed' THEN attempt END AS last_failure_attempt FROM o""")
def lease_finish(spark, sf):
    return leases.finish(_jobs(spark, sf), _reports(spark, sf), _now(), 1000).select("job_id", "status", "lease_agent_id", "finished_at", "last_failure_attempt")


@query(f"WITH {_JOBS_SQL} SELECT job_id, CASE WHEN status = 'running' AND job_id % 2 = 0 AND ends > {NOW_SQL} THEN {NOW_SQL} + INTERVAL 1 MINUTE ELSE ends END AS lease_expires_at FROM j")
def lease_heartbeat(spark, sf):
    beats = _reports(spark, sf).withColumn("agent_id", F.concat(F.lit("a"), F.substring("agent_id", 2, 9))).where("job_id % 2 = 0").select("job_id", "attempt", "lease_token")
    holders = _jobs(spark, sf).select("job_id", F.col("lease_agent_id").alias("agent_id"))
    return leases.heartbeat(_jobs(spark, sf), beats.join(holders, "job_id"), _now(), 60_000).select("job_id", "lease_expires_at")


@query("SELECT c_custkey AS job_id, coalesce(max(o_orderkey), -1) + 1 AS next_sequence FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def next_sequence(spark, sf):
    jobs = table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"))
    return leases.next_sequence(jobs, table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("sequence")))


_UUID_SQL = "h[1:8] || '-' || h[9:12] || '-4' || h[14:16] || '-a' || h[18:20] || '-' || h[21:32]"


@query(f"""
SELECT 'user' AS actor_type, 'u' || user_id AS actor_id, 'event.' || event_type AS action, {_UUID_SQL} AS project_id, 'tool/' || event_type AS tool, CASE event_type WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS outcome,
  h AS request_hash, upper({_UUID_SQL}) AS correlation_id, h[1:32] AS trace_id, h[1:16] AS span_id, 'event' AS resource_type, event_id::VARCHAR AS resource_id, CASE event_type WHEN 'error' THEN 'E:' || user_id || '/x' END AS error_code
FROM (SELECT *, sha256(event_id::VARCHAR) AS h FROM events)""")
def audit_events(spark, sf):
    sha = F.sha2(F.col("event_id").cast("string"), 256)
    part = lambda a, n: F.substring(sha, a, n)
    uuid = F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))
    failed = F.col("event_type") == "error"
    rows = table(spark, sf, "events").select(
        F.lit("user").alias("actor_type"), F.concat(F.lit("u"), "user_id").alias("actor_id"), F.concat(F.lit("event."), "event_type").alias("action"), uuid.alias("project_id"), F.concat(F.lit("tool/"), "event_type").alias("tool"),
        F.when(failed, "failed").otherwise("succeeded").alias("outcome"), sha.alias("request_hash"), F.upper(uuid).alias("correlation_id"), part(1, 32).alias("trace_id"),
        part(1, 16).alias("span_id"), F.lit("event").alias("resource_type"), F.col("event_id").cast("string").alias("resource_id"), F.when(failed, F.concat(F.lit("E:"), "user_id", F.lit("/x"))).alias("error_code"),
    )
    return persist.audit_rows(rows)


@query("SELECT src_usr, dst_usr, k FROM (SELECT l_partkey AS src_usr, l_suppkey AS dst_usr, row_number() OVER (ORDER BY l_returnflag, l_partkey, l_suppkey, l_linenumber NULLS FIRST, max(l_discount) DESC) AS k FROM lineitem GROUP BY l_returnflag, l_partkey, l_suppkey, l_linenumber) WHERE k <= 100")
def edges_in_order(spark, sf):
    """The first 100 edges of the total order, with their places."""
    edges = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("edge_type"), F.col("l_partkey").alias("src_usr"), F.col("l_suppkey").alias("dst_usr"), F.col("l_linenumber").alias("line")).agg(F.max("l_discount").alias("confidence"))
    first = graph.in_order(edges.withColumn("file", F.lit("f"))).limit(100)
    place = F.row_number().over(Window.orderBy("edge_type", "src_usr", "dst_usr", "line", F.desc("confidence")))
    return first.select("src_usr", "dst_usr", place.cast("long").alias("k"))


# Chunks without an SQL form: held against plain Python


@query()
def chunk_split(spark, sf):
    """Documents under a small budget: (doc_id, part_index, part). The parts are cut by what has been taken before."""
    parts = dealt(table(spark, sf, "documents")).where("text is not null").select("doc_id", chunks.split_parts(2048, 120)("text").alias("parts"))
    return parts.select("doc_id", F.posexplode("parts").alias("part_index", "part"))


@query("""
WITH p AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '' AND x <> '.') AS seg FROM pages)
SELECT page_id, '/' || array_to_string(seg, '/') AS key, '/' || array_to_string(seg[:-2], '/') AS up FROM p""")
def path_keys(spark, sf):
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", chunks.path_key(F.concat(F.lit("/./"), path)).alias("key"), chunks.path_key(F.concat(path, F.lit("/.."))).alias("up"))
