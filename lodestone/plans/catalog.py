"""The library's operators on the driver's tables: a query of each, and the SQL that gives the same rows.

The tables hold no code symbols, so each operator runs on what resembles its input: documents stand for chunks, parts
and suppliers for symbols, pages for paths, events for jobs. Nothing is cut from the tables to make a check cheap; the
limits that occur are those of top-k operators.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import acl as acl_ops
from lodestone.operators import embedding, evaluation, fusion, generations, graph, signals, symbols
from lodestone.storage import dealt, stash, table
from lodestone.streaming import leases

FLAGSHIP = "vector_topk"
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_rng = random.Random(7)
PROBE = [round(_rng.uniform(-1, 1), 3) for _ in range(64)]
_PROBE_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in PROBE) + "]"


@query(f"""
SELECT vec_id, label, round(greatest(0.0, list_cosine_similarity(embedding::DOUBLE[], {_PROBE_SQL})), 9) AS score
FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_PROBE_SQL}) DESC, vec_id LIMIT 20""")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    best = signals.vector_topk(table(spark, sf, "embeddings"), PROBE, "vec_id", 20)
    return best.select("vec_id", "label", F.round("score", 9).alias("score"))


@query("""
WITH q AS (SELECT vec_id AS asked, embedding AS wanted FROM embeddings WHERE vec_id = (SELECT max(vec_id) FROM embeddings))
SELECT vec_id, asked, round(greatest(0.0, list_cosine_similarity(embedding::DOUBLE[], wanted::DOUBLE[])), 9) AS score
FROM embeddings CROSS JOIN q ORDER BY list_cosine_similarity(embedding::DOUBLE[], wanted::DOUBLE[]) DESC, vec_id LIMIT 20""")
def vector_of_row(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest vectors to a stored one, that of the largest id, which stays a relation of one row."""
    rows = table(spark, sf, "embeddings")
    asked = rows.agg(F.max_by(F.struct(F.col("vec_id").alias("asked"), "embedding"), "vec_id").alias("q")).select("q.*")
    return signals.vector_topk_of(rows, asked, "vec_id").select("vec_id", "asked", F.round("score", 9).alias("score"))


@query("""
SELECT doc_id, CASE WHEN source || '/' || lang = 'src3/en' THEN 1.0 ELSE 0.95 END::DOUBLE AS score
FROM documents WHERE source || '/' || lang = 'src3/en' OR lang = 'src3/en' OR (source = 'src3' AND doc_id % 10 = 3)
ORDER BY score DESC, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, source, lpad(doc_id::VARCHAR, 12, '0') LIMIT 100""")
def exact_lookup(spark, sf):
    kind = F.when(F.col("lang") == "en", "definition").when(F.col("lang") == "fr", "declaration").otherwise("documentation")
    name = F.when((F.col("source") == "src3") & (F.col("doc_id") % 10 == 3), "src3/en").otherwise(F.col("lang"))
    chunks = table(spark, sf, "documents").select(
        "doc_id", F.concat_ws("/", "source", "lang").alias("stable_usr"), F.col("source").alias("qualified_name"), name.alias("name"), kind.alias("chunk_kind"),
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("stable_key"), F.lit("all").alias("repository_id"), F.lit("a").alias("path"),
    )
    return signals.exact_symbols(chunks.where("stable_usr is not null"), acl_ops.acl_table(spark, [("all", "")]), "src3/en", 100).select("doc_id", "score")


_TERMS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


@query(f"""
WITH p AS (SELECT doc_id, unnest({_TERMS}) AS t FROM documents)
SELECT doc_id FROM p WHERE t IN ('the', 'of', 'and') GROUP BY doc_id HAVING count(DISTINCT t) = 3""")
def fts_all_terms(spark, sf):
    index = signals.postings(dealt(table(spark, sf, "documents")), "doc_id", only=signals.query_terms("the of and"))
    return signals.fts_match(index, "the of and", "doc_id").select("doc_id")


@query(f"""
SELECT t AS token, count(DISTINCT doc_id) AS n_docs, count(*) AS n_places
FROM (SELECT doc_id, unnest({_TERMS}) AS t FROM documents) GROUP BY t""")
def postings_df(spark, sf):
    index = signals.postings(dealt(table(spark, sf, "documents")), "doc_id")
    return index.groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("positions").cast("long")).alias("n_places"))


@query()
def fts_cover_density(spark, sf):
    docs = dealt(table(spark, sf, "documents"))
    hits = signals.fts_match(signals.postings(docs, "doc_id", only=signals.query_terms("the of and")), "the of and", "doc_id").withColumn("score", F.round(signals.cover_density("lists"), 9))
    return hits.select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(50)


_HOST = "regexp_extract(url, '://([^/?#]*)', 1)"
_PATH = "regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1)"
ACL_ENTRIES = [("net", "en"), ("net", "fr"), ("com", ""), ("org", "de")]


def _paths(spark, sf):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", F.element_at(F.split(host, "\\."), -1).alias("repository_id"), F.regexp_extract("url", "://[^/?#]*/?([^?#]*)", 1).alias("path"))


@query(f"""
WITH p AS (SELECT page_id, string_split({_HOST}, '.')[-1] AS repository_id, {_PATH} AS path FROM pages),
a(r, x) AS (VALUES {", ".join(f"('{r}', '{p}')" for r, p in ACL_ENTRIES)})
SELECT page_id, repository_id, path FROM p WHERE EXISTS (SELECT 1 FROM a WHERE r = repository_id AND (x = '' OR path = x OR starts_with(path, x || '/')))""")
def acl_prefix_semi(spark, sf):
    return acl_ops.visible(_paths(spark, sf), acl_ops.acl_table(spark, ACL_ENTRIES))


PREFIXES = [("", "read"), ("en", "write"), ("fr", "none"), ("de", "read"), ("en/1", "none")]


@query(f"""
WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), a(prefix, access) AS (VALUES {", ".join(f"('{p}', '{x}')" for p, x in PREFIXES)})
SELECT page_id, path, max_by(prefix, length(prefix)) AS prefix, max_by(access, length(prefix)) AS access
FROM p JOIN a ON prefix = '' OR path = prefix OR starts_with(path, prefix || '/') GROUP BY page_id, path""")
def longest_prefix(spark, sf):
    rules = spark.createDataFrame(PREFIXES, "prefix string, access string")
    return acl_ops.longest_prefix(_paths(spark, sf).select("page_id", "path"), rules, "page_id", "path", "prefix", "access")


@query("""
SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN LATERAL (
  SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) ON TRUE""")
def lateral_topn(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    best = signals.top_per(table(spark, sf, "customer").select("c_custkey"), orders, ("c_custkey", "o_custkey"), [F.desc("o_totalprice"), F.col("o_orderkey")], 2)
    return best.select("c_custkey", "o_orderkey", "o_totalprice")


def _signals(spark, sf):
    """Two rankings of the documents of each query, a language and source: by length, and by id from the end."""
    docs = table(spark, sf, "documents").where("n_chars > 0").select(
        F.concat_ws("/", "lang", "source").alias("query"), F.col("doc_id").cast("string").alias("chunk_key"), F.concat(F.lit("f"), F.col("doc_id") % 13).alias("file_key"),
        F.concat(F.lit("s"), F.col("doc_id") % 7).alias("symbol_key"), "doc_id", "n_chars",
    )
    one = docs.select("query", F.lit("fts").alias("source"), "chunk_key", "file_key", "symbol_key", F.col("n_chars").cast("double").alias("score"))
    two = docs.select("query", F.lit("vector").alias("source"), "chunk_key", "file_key", "symbol_key", F.col("doc_id").cast("double").alias("score"))
    return one.unionByName(two)


_RRF_SQL = """
WITH RECURSIVE d AS (SELECT concat_ws('/', lang, source) AS query, doc_id, doc_id::VARCHAR AS chunk_key, 'f' || doc_id % 13 AS file_key, 's' || doc_id % 7 AS symbol_key, n_chars FROM documents WHERE n_chars > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n_chars DESC, chunk_key) AS i, row_number() OVER (PARTITION BY query ORDER BY doc_id DESC, chunk_key) AS j FROM d),
u AS (SELECT *, 0.0E0 + 0.0E0 + 0.8E0 / (60 + i) + 0.7E0 / (60 + j) + 0.0E0 AS fusion_score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY fusion_score DESC, chunk_key) AS rank FROM u)
"""


@query(_RRF_SQL + "SELECT query, chunk_key, round(fusion_score, 12) AS fusion_score, rank::INTEGER AS rank FROM r")
def rrf_fusion(spark, sf):
    return fusion.rrf(_signals(spark, sf), by=["query"]).select("query", "chunk_key", F.round("fusion_score", 12).alias("fusion_score"), "rank")


@query(_RRF_SQL + """SELECT query, chunk_key, 'fts' AS source, i::INTEGER AS source_rank, n_chars::DOUBLE AS source_score, round(0.8E0 / (60 + i), 12) AS part FROM r
UNION ALL SELECT query, chunk_key, 'vector', j::INTEGER, doc_id::DOUBLE, round(0.7E0 / (60 + j), 12) FROM r""")
def fusion_evidence(spark, sf):
    proof = fusion.rrf(_signals(spark, sf), by=["query"]).select("query", "chunk_key", F.explode("evidence").alias("e"))
    return proof.select("query", "chunk_key", "e.source", "e.source_rank", "e.source_score", F.round("e.weighted_rrf_score", 12).alias("part"))


@query(_RRF_SQL + """, s AS (SELECT query, chunk_key, rank, (n_chars % 101) / 101 AS score FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_key) AS rerank_rank FROM s),
w AS (SELECT *, (1 - 0.7E0) / rank + 0.7E0 / rerank_rank AS x FROM t)
SELECT query, chunk_key, rerank_rank::INTEGER AS rerank_rank, row_number() OVER (PARTITION BY query ORDER BY x DESC, chunk_key)::INTEGER AS rank FROM w""")
def rerank_fusion(spark, sf):
    ranked = fusion.rrf(_signals(spark, sf), by=["query"])
    scores = table(spark, sf, "documents").where("n_chars > 0").select(F.concat_ws("/", "lang", "source").alias("query"), F.col("doc_id").cast("string").alias("chunk_key"), (F.col("n_chars") % 101 / 101).alias("score"))
    return fusion.rerank(ranked, scores, by=["query"]).select("query", "chunk_key", "rerank_rank", "rank")


@query(_RRF_SQL + """, k AS (SELECT *, row_number() OVER (PARTITION BY query, file_key ORDER BY rank) AS place FROM r)
SELECT query, chunk_key, row_number() OVER (PARTITION BY query ORDER BY rank)::INTEGER AS rank FROM k WHERE place <= 5""")
def diversity_single_cap(spark, sf):
    ranked = fusion.rrf(_signals(spark, sf), by=["query"])
    return fusion.diversify(ranked, per_symbol=1 << 40, per_file=5, limit=1 << 40, by=["query"]).select("query", "chunk_key", "rank")


#: The greedy pass as a walk down the ranks, which carries what has been taken so far.
@query(_RRF_SQL + """, g AS (
  SELECT query, 0::BIGINT AS rank, NULL::VARCHAR AS chunk_key, NULL::VARCHAR AS symbol_key, NULL::VARCHAR AS file_key, []::VARCHAR[] AS symbols, []::VARCHAR[] AS files, false AS taken FROM r WHERE rank = 1
  UNION ALL
  SELECT query, rank, chunk_key, symbol_key, file_key, CASE WHEN taken THEN list_append(symbols, symbol_key) ELSE symbols END, CASE WHEN taken THEN list_append(files, file_key) ELSE files END, taken FROM (
    SELECT r.query, r.rank, r.chunk_key, r.symbol_key, r.file_key, g.symbols, g.files,
      len(g.files) < 20 AND len([x FOR x IN g.symbols IF x = r.symbol_key]) < 3 AND len([x FOR x IN g.files IF x = r.file_key]) < 5 AS taken
    FROM g JOIN r ON r.query = g.query AND r.rank = g.rank + 1))
SELECT query, chunk_key, symbol_key, file_key, row_number() OVER (PARTITION BY query ORDER BY rank)::INTEGER AS rank FROM g WHERE taken""")
def diversity_two_caps(spark, sf):
    return fusion.diversify(fusion.rrf(_signals(spark, sf), by=["query"]), by=["query"]).select("query", "chunk_key", "symbol_key", "file_key", "rank")


#: The same for packing: a row that fits what is left is taken, until there are 20.
@query(_RRF_SQL + """, z AS (SELECT r.query, r.rank, r.chunk_key, octet_length(encode(text)) AS n FROM r JOIN documents ON documents.doc_id = r.doc_id),
g AS (
  SELECT query, 0::BIGINT AS rank, NULL::VARCHAR AS chunk_key, 0::BIGINT AS n, 65536::BIGINT AS room, 0 AS k, false AS taken FROM z WHERE rank = 1
  UNION ALL
  SELECT z.query, z.rank, z.chunk_key, z.n, CASE WHEN z.n <= room AND k < 20 THEN room - z.n ELSE room END, CASE WHEN z.n <= room AND k < 20 THEN k + 1 ELSE k END, z.n <= room AND k < 20
  FROM g JOIN z ON z.query = g.query AND z.rank = g.rank + 1)
SELECT query, chunk_key, n AS utf8_bytes, k::INTEGER AS rank FROM g WHERE taken""")
def budget_packing(spark, sf):
    ranked = fusion.rrf(_signals(spark, sf), by=["query"]).select("query", "chunk_key", "rank")
    sizes = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_key"), F.octet_length("text").cast("long").alias("utf8_bytes"))
    return fusion.packed(ranked.join(sizes, "chunk_key"), 1 << 16, by=["query"]).select("query", "chunk_key", "utf8_bytes", F.col("rank").cast("int").alias("rank"))


def _edges(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("l_returnflag").alias("edge_type"), F.col("l_discount").alias("confidence"))


_EDGES_SQL = "SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, l_returnflag AS edge_type, max(l_discount) AS confidence FROM lineitem GROUP BY ALL"


@query(_EDGES_SQL)
def edge_max_dedupe(spark, sf):
    return graph.merge_edges(_edges(spark, sf), ["src", "dst", "edge_type"])


@query(f"""
WITH e AS ({_EDGES_SQL})
SELECT src, dst, edge_type, confidence, dst AS neighbour FROM e WHERE src = 's1' AND edge_type IN ('A', 'R')
UNION ALL SELECT src, dst, edge_type, confidence, src FROM e WHERE dst = 's1' AND src <> dst AND edge_type IN ('A', 'R')""")
def graph_one_hop(spark, sf):
    merged = graph.merge_edges(_edges(spark, sf), ["src", "dst", "edge_type"])
    return signals.one_hop(merged, "s1", "src", "dst", ["A", "R"])


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey % 997 AS a, l_suppkey % 997 + 1 AS b FROM lineitem),
w(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node WHERE w.depth < 3)
SELECT node::BIGINT AS node, min(depth)::INTEGER AS depth FROM w GROUP BY node""")
def bfs_bounded(spark, sf):
    edges = table(spark, sf, "lineitem").select((F.col("l_partkey") % 997).alias("src"), (F.col("l_suppkey") % 997 + 1).alias("dst"))
    return graph.bfs(edges, spark.createDataFrame([(1,)], "node long"), 3)


@query("SELECT l_partkey, count(DISTINCT l_suppkey || ':' || l_linestatus) AS n_identities FROM lineitem GROUP BY l_partkey HAVING n_identities > 1")
def ambiguous_keys(spark, sf):
    return symbols.ambiguous_keys(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey", "l_linestatus")


@query("""
WITH s AS (SELECT 'c' || c_custkey AS usr FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)
SELECT DISTINCT 'calls' AS edge_type, 'c' || o_custkey AS src_usr, 'o' || o_orderkey AS dst_usr FROM orders
WHERE EXISTS (SELECT 1 FROM s WHERE usr = 'c' || o_custkey) AND EXISTS (SELECT 1 FROM s WHERE usr = 'o' || o_orderkey)""")
def semi_anti_endpoints(spark, sf):
    return _relations(spark, sf)[0].where("edge_type <> 'owns'").select("edge_type", "src_usr", "dst_usr")


def _relations(spark, sf):
    """Customers and orders as symbols, some of them missing; orders as call edges, each extracted twice; owners by nation."""
    none = F.lit(None).cast("string")
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    symbols_ = c.where("c_custkey % 3 <> 0").select(F.concat(F.lit("c"), "c_custkey").alias("stable_usr"), none.alias("owner_usr")).unionByName(
        o.where("o_orderkey % 5 <> 0").select(F.concat(F.lit("o"), "o_orderkey").alias("stable_usr"), F.concat(F.lit("c"), "o_custkey").alias("owner_usr")))
    edges = o.select(F.lit("calls").alias("edge_type"), F.concat(F.lit("c"), "o_custkey").alias("src_usr"), F.concat(F.lit("o"), "o_orderkey").alias("dst_usr"), none.alias("file"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"), F.lit(0.5).alias("confidence"))
    return graph.relation_index(edges.unionByName(edges.withColumn("confidence", F.lit(0.9))), stash(symbols_, "symbols"))


@query("""
WITH c AS (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0), o AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0)
SELECT 2 * (SELECT count(*) FROM orders) AS source_edges, (SELECT count(*) FROM orders) AS deduplicated, (SELECT count(*) FROM orders) - (SELECT count(*) FROM o WHERE o_custkey IN (FROM c)) AS unresolved,
  (SELECT count(*) FROM o WHERE o_custkey IN (FROM c)) AS owns_edges, (SELECT count(*) FROM o WHERE o_custkey NOT IN (FROM c)) AS unresolved_owners""")
def relation_counts(spark, sf):
    return _relations(spark, sf)[1]


@query("""
SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\\.[0-9]+)?|[^\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}\\x00-\\x7F]|[^\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}A-Za-z0-9_]'))) END::INTEGER AS tokens FROM documents""")
def token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT DISTINCT sha256(text) AS content_hash, text, length(text)::INTEGER AS token_count FROM documents")
def content_dedupe(spark, sf):
    docs = table(spark, sf, "documents").select(tx.content_hash(F.col("text")).alias("content_hash"), "text", F.length("text").alias("token_count"))
    return embedding.distinct_contents(docs)


@query("SELECT doc_id, octet_length(encode(text))::INTEGER AS n_bytes FROM documents")
def utf8_bytes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.utf8_bytes(F.col("text")).alias("n_bytes"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS excerpt FROM documents")
def line_slice(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.line_slice(F.col("text"), 2, 4).alias("excerpt"))


_COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("SELECT " + ", ".join(f"(SELECT count(*) FROM {t}) AS n_{t}" for t in _COUNTED))
def snapshot_counts(spark, sf):
    return generations.snapshot({f"n_{t}": table(spark, sf, t) for t in _COUNTED})


@query("""
WITH g AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'superseded' WHEN 'O' THEN 'active' ELSE 'failed' END AS status FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, status IN ('active', 'superseded') ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM g)
SELECT o_orderkey AS id, o_custkey AS project_id, status FROM r WHERE o_orderkey % 50 <> 0
  AND ((status = 'superseded' AND k > 2) OR status = 'failed') AND o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 30 DAY""")
def retention_candidates(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "superseded").when(F.col("o_orderstatus") == "O", "active").otherwise("failed")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), status.alias("status"), F.col("o_orderdate").alias("published_at"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderdate").alias("validated_at"), F.lit(None).cast("string").alias("gc_claim_hash"))
    running = rows.where("id % 50 = 0").select(F.col("id").alias("generation_id"))
    return generations.retention(rows, running, F.lit("2000-01-01").cast("timestamp"), limit=1 << 30).select("id", "project_id", "status")


@query("""
WITH e AS (SELECT *, CASE WHEN user_id % 3 = 0 AND ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-15' THEN row_number() OVER (PARTITION BY user_id % 3 = 0 AND ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-15' ORDER BY ts, event_id) END AS k FROM events)
SELECT event_id, CASE WHEN k <= 1000 THEN CASE WHEN event_id % 4 < 3 THEN 'queued' ELSE 'failed' END WHEN user_id % 3 = 0 THEN 'running' ELSE 'succeeded' END AS status FROM e""")
def lease_expiry(spark, sf):
    running = F.col("user_id") % 3 == 0
    jobs = table(spark, sf, "events").select(
        "event_id", F.when(running, "running").otherwise("succeeded").alias("status"), (F.col("event_id") % 4).alias("attempt"), F.lit(3).alias("max_attempts"), F.col("ts").alias("available_at"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("lease_expires_at"), F.lit("a").alias("lease_agent_id"), F.lit("t").alias("lease_token"), F.lit(None).cast("string").alias("last_failure_agent_id"), F.lit(None).cast("string").alias("last_error_code"),
    )
    return leases.recover_expired(jobs, F.lit("2024-01-15").cast("timestamp"), 1000, limit=1000, key="event_id").select("event_id", "status")


@query("""
WITH e AS (SELECT user_id AS job_id, event_id % 5 AS sequence, event_type, user_id % 9 <> 0 AS live, sha256('{"level":"info","event_type":"' || event_type || '","fields":"{}"}') AS digest FROM events),
k AS (SELECT *, CASE WHEN live THEN row_number() OVER (PARTITION BY job_id, sequence, live ORDER BY digest) END AS nth, first(digest) OVER (PARTITION BY job_id, sequence, live ORDER BY digest) AS top FROM e),
s AS (SELECT DISTINCT job_id, sequence FROM e WHERE live),
n AS (SELECT job_id, sequence, sequence = count(*) OVER (PARTITION BY job_id ORDER BY sequence) - 1 AS reached FROM s)
SELECT job_id::VARCHAR AS job_id, sequence, event_type, CASE WHEN NOT live THEN 'lease_lost' WHEN reached AND nth = 1 THEN 'accepted' WHEN reached AND digest = top THEN 'already_applied' ELSE 'sequence_conflict' END AS status
FROM k LEFT JOIN n USING (job_id, sequence)""")
def event_sequence(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("job_id"), F.when(F.col("user_id") % 9 == 0, 2).otherwise(1).alias("attempt"), F.lit("t").alias("lease_token"), (F.col("event_id") % 5).alias("sequence"),
        F.lit("info").alias("level"), "event_type", F.lit("{}").alias("fields"),
    )
    held = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("job_id"), F.lit(1).alias("attempt"), F.lit("t").alias("lease_token")).distinct()
    return leases.append_events(events, held)


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf):
    return leases.windowed_counts(table(spark, sf, "events"), "ts", "1 day", "1 hour", "event_type")


@query("WITH b(le) AS (VALUES " + ", ".join(f"({float(b)}::DOUBLE)" for b in evaluation.BUCKETS) + ") SELECT event_type, le, count(*) FILTER (value <= le) AS n, count(value) AS total FROM events, b GROUP BY ALL")
def latency_histogram(spark, sf):
    return evaluation.histogram(table(spark, sf, "events"), "value", ["event_type"]).drop("sum")


@query("WITH b(le) AS (VALUES " + ", ".join(f"({float(b)}::DOUBLE)" for b in evaluation.BUCKETS) + """),
h AS (SELECT event_type, le, count(*) FILTER (value <= le) AS n, count(value) AS total FROM events, b GROUP BY ALL),
w AS (SELECT *, coalesce(lag(n) OVER k, 0) AS n0, coalesce(lag(le) OVER k, 0.0) AS low, 0.95 * total AS want FROM h WINDOW k AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, round(coalesce(min(low + (le - low) * (want - n0) / (n - n0)) FILTER (n >= want AND n0 < want), max(le)), 6) AS quantile FROM w GROUP BY event_type""")
def latency_p95(spark, sf):
    found = evaluation.bucket_quantile(evaluation.histogram(table(spark, sf, "events"), "value", ["event_type"]), 0.95, ["event_type"])
    return found.withColumn("quantile", F.round("quantile", 6))


@query("""
WITH r AS (SELECT lang AS language, doc_id % 40 AS case_id, doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n_chars DESC, doc_id) AS rank FROM r),
c AS (SELECT case_id, language, avg(CASE WHEN rank <= 20 THEN 1.0 ELSE 0.0 END) AS recall FROM k WHERE quality = 1 GROUP BY ALL)
SELECT language, count(*) AS cases, round(avg(recall), 9) AS mean_recall, round(avg(recall), 9) >= 0.9 AS passed FROM c GROUP BY GROUPING SETS ((language), ())""")
def recall_by_group(spark, sf):
    rows = table(spark, sf, "documents").where("lang is not null").join(table(spark, sf, "labels"), "doc_id").select(F.col("lang").alias("language"), (F.col("doc_id") % 40).alias("case_id"), F.col("doc_id").alias("chunk_key"), "n_chars", "quality")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("n_chars"), "chunk_key")))
    out = evaluation.recall_at(ranked.where("quality = 1").select("case_id", "language", "chunk_key"), ranked.select("case_id", "chunk_key", "rank"))
    return out.withColumn("mean_recall", F.round("mean_recall", 9)).withColumn("passed", F.col("mean_recall") >= 0.9)


_GOLD_SQL = """
WITH e AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id % 3 <> 0 GROUP BY doc_id),
a AS (SELECT doc_id, min(CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END) AS q FROM labels WHERE doc_id % 5 <> 0 GROUP BY doc_id),
c AS (SELECT doc_id, CASE WHEN a.q IS NULL THEN 'missing' WHEN e.q IS NULL THEN 'unexpected' WHEN a.q <> e.q THEN 'mismatch' ELSE 'matched' END AS status FROM e FULL JOIN a USING (doc_id))
"""


def _gold(spark, sf):
    labels = table(spark, sf, "labels").where("quality is not null")
    e = labels.where("doc_id % 3 <> 0").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    a = labels.where("doc_id % 5 <> 0").groupBy("doc_id").agg(F.min(F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).alias("quality"))
    return evaluation.compare(e, a, ["doc_id"], ["quality"])


@query(_GOLD_SQL + "SELECT doc_id, status FROM c")
def gold_full_outer(spark, sf):
    return _gold(spark, sf).select("doc_id", "status")


@query(_GOLD_SQL + """, n AS (SELECT count(*) FILTER (status IN ('matched', 'mismatch')) AS found, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (status = 'unexpected') AS unexpected,
  count(*) FILTER (status = 'mismatch') AS mismatched FROM c)
SELECT *, round(found / (found + unexpected), 9) AS precision, round(found / (found + missing), 9) AS recall FROM n""")
def gold_precision_recall(spark, sf):
    return evaluation.precision_recall(_gold(spark, sf)).withColumn("precision", F.round("precision", 9)).withColumn("recall", F.round("recall", 9))


@query("""
SELECT doc_id, source, sample_rank::INTEGER AS sample_rank FROM (SELECT doc_id, source,
  row_number() OVER (PARTITION BY source ORDER BY sha256('seed' || chr(31) || source || chr(31) || doc_id), doc_id) AS sample_rank FROM documents WHERE source IS NOT NULL) WHERE sample_rank <= 5""")
def stratified_sample(spark, sf):
    docs = table(spark, sf, "documents").where("source is not null")
    return evaluation.stratified_sample(docs.select("doc_id", "source"), "source", "doc_id", 5, "seed").select("doc_id", "source", "sample_rank")


@query("""
WITH p(t, id, role) AS (VALUES ('team', 'AUTOMOBILE', 'viewer'), ('team', 'BUILDING', 'operator'), ('team', 'MACHINERY', 'admin')),
r(role, k) AS (VALUES ('none', 1), ('viewer', 2), ('operator', 3), ('maintainer', 4), ('admin', 5)),
u AS (SELECT c_custkey AS user_id, role FROM customer JOIN p ON id = c_mktsegment UNION ALL SELECT c_custkey, 'maintainer' FROM customer WHERE c_nationkey = 1)
SELECT user_id, max_by(role, k) AS role FROM u JOIN r USING (role) GROUP BY user_id""")
def role_max(spark, sf):
    customer = table(spark, sf, "customer")
    teams = spark.createDataFrame([("team", "AUTOMOBILE", "viewer"), ("team", "BUILDING", "operator"), ("team", "MACHINERY", "admin")], "principal_type string, principal_id string, role string")
    direct = customer.where("c_nationkey = 1").select(F.lit("user").alias("principal_type"), F.col("c_custkey").cast("string").alias("principal_id"), F.lit("maintainer").alias("role"))
    members = customer.select(F.col("c_custkey").cast("string").alias("user_id"), F.col("c_mktsegment").alias("team_id"))
    return acl_ops.strongest_role(teams.unionByName(direct), members).select(F.col("user_id").cast("long").alias("user_id"), "role")


@query("""
WITH u AS (SELECT DISTINCT doc_id FROM documents WHERE lang IS DISTINCT FROM 'es'), c AS (SELECT DISTINCT doc_id FROM labels)
SELECT count(*) AS units, count(c.doc_id) AS covered, round(count(c.doc_id) / count(*), 9) AS ratio, count(c.doc_id) / count(*) >= 0.99 AS passed FROM u LEFT JOIN c USING (doc_id)""")
def coverage_report(spark, sf):
    docs = table(spark, sf, "documents")
    report, _ = evaluation.coverage(docs, table(spark, sf, "labels"), docs.where("lang = 'es'"), "doc_id")
    return report.withColumn("ratio", F.round("ratio", 9))


@query("SELECT DISTINCT doc_id FROM documents WHERE lang IS DISTINCT FROM 'es' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def coverage_gap(spark, sf):
    docs = table(spark, sf, "documents")
    return evaluation.coverage(docs, table(spark, sf, "labels"), docs.where("lang = 'es'"), "doc_id")[1]


@query("""
WITH k AS (SELECT l_partkey AS root, l_suppkey AS file, count(*) AS n, count(DISTINCT l_shipdate) AS kinds FROM lineitem GROUP BY ALL)
SELECT root, sum(n)::BIGINT AS commands, count(*) AS files, count(*) FILTER (kinds > 1) AS varied FROM k GROUP BY root""")
def command_audit(spark, sf):
    return evaluation.variants(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("root"), F.col("l_suppkey").alias("file"), F.col("l_shipdate").alias("content_hash")))


@query("""
WITH s AS (SELECT s_suppkey, s_nationkey FROM supplier), o AS (SELECT 's' || s_suppkey AS src_usr, 'p' || p_partkey AS dst_usr FROM part JOIN s ON s_suppkey = p_partkey % 150 + 1)
SELECT src_usr, dst_usr FROM o""")
def owns_derivation(spark, sf):
    parts = table(spark, sf, "part").select(F.concat(F.lit("p"), "p_partkey").alias("stable_usr"), F.concat(F.lit("s"), F.col("p_partkey") % 150 + 1).alias("owner_usr"))
    owners = table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("stable_usr"), F.lit(None).cast("string").alias("owner_usr"))
    return graph.owns_edges(stash(parts.unionByName(owners), "symbols")).select("src_usr", "dst_usr")
