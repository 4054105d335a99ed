"""Queries of what reads, merges, indexes and streams: records written from the driver's tables and read back, with SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import cells, generations, ranked, symbols
from lodestone.plans.catalog import query
from lodestone.sources import blocks, builds, code, extraction, lexing
from lodestone.storage import dealt, new_path, stash, table
from lodestone.streaming import leases

# Units merged in order


def _records(spark, sf):
    """Lines as records of parts in five units. Every fifth part changes its kind in the fourth; of each tenth some units disagree in themselves."""
    li = table(spark, sf, "lineitem")
    part, unit, line = F.col("l_partkey"), (F.col("l_suppkey") % 5).cast("int"), F.col("l_linenumber")
    odd = F.concat(F.lit("k"), (unit > 2).cast("int").cast("string"), F.when((part % 10 == 0) & (line == 7), "x").otherwise(""))
    kind = F.when(part % 5 == 0, odd).otherwise(F.when(part % 2 == 0, "class").otherwise("field"))
    place = F.array(F.struct(F.lit("definition").alias("kind"), F.element_at(F.array(*map(F.lit, ("b", "B", "a"))), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("file"), line.alias("start_line")))
    note = F.when(line > 4, F.element_at(F.array(*map(F.lit, NOTES)), (F.col("l_suppkey") % len(NOTES) + 1).cast("int")))
    half = F.floor(part / 2).cast("string")
    return li.select(
        F.concat(F.lit("u"), part).alias("stable_usr"), unit.alias("unit"), kind.alias("kind"), F.concat(F.lit("q"), half).alias("qualified_name"), F.concat(F.lit("n"), part).alias("name"), F.concat(F.lit("d"), half).alias("display_name"),
        F.lit(None).cast("string").alias("owner_usr"), F.when(line % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("T"), half)).alias("type_spelling"), F.when(line % 3 == 0, F.lit("")).otherwise("int").alias("result_type"),
        place.alias("locations"), note.alias("documentation"),
    )


NOTES = ("alpha", "Beta!", "gamma", "Delta", "ALPHA", "éclat", "zz")
_UNITS_SQL = f"""
WITH r AS (
  SELECT 'u' || l_partkey AS usr, l_partkey AS part, l_suppkey % 5 AS unit, CASE WHEN l_partkey % 5 = 0 THEN 'k' || (l_suppkey % 5 > 2)::INTEGER || CASE WHEN l_partkey % 10 = 0 AND l_linenumber = 7 THEN 'x' ELSE '' END WHEN l_partkey % 2 = 0 THEN 'class' ELSE 'field' END AS kind,
    ['b', 'B', 'a'][l_suppkey % 3 + 1] AS file, l_linenumber AS line, CASE WHEN l_linenumber > 4 THEN {list(NOTES)}[l_suppkey % {len(NOTES)} + 1] END AS note,
    CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'T' || l_partkey // 2 END AS type, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'int' END AS result FROM lineitem),
own AS (SELECT usr, unit, count(DISTINCT kind) AS kinds, count(*) AS n, count(DISTINCT (file, line)) AS places FROM r GROUP BY ALL),
good AS (SELECT r.* FROM r JOIN own USING (usr, unit) WHERE kinds = 1),
first AS (SELECT usr, unit, kind, first_value(kind) OVER (PARTITION BY usr ORDER BY unit) AS before FROM (SELECT DISTINCT usr, unit, kind FROM good)),
late AS (SELECT usr, min(unit) AS since FROM first WHERE kind <> before GROUP BY usr),
dropped AS (
  SELECT usr, sum(n) AS n FROM own WHERE kinds > 1 GROUP BY usr
  UNION ALL SELECT usr, count(DISTINCT (file, line)) FROM good JOIN late USING (usr) WHERE unit < since GROUP BY usr
  UNION ALL SELECT usr, sum(places) FROM own JOIN late USING (usr) WHERE kinds = 1 AND unit >= since GROUP BY usr)
"""


@query(_UNITS_SQL + """
SELECT usr AS stable_usr, any_value(kind) AS kind, max(type) AS type_spelling, max(result) AS result_type, count(DISTINCT (file, line)) AS n_places,
  min((icu_sort_key(file, 'en'), line, file))[3] AS first_file, arg_min(note, (-length(note), icu_sort_key(note, 'en'))) FILTER (note IS NOT NULL) AS documentation,
  sha256('{"kind":"' || any_value(kind) || '","qualified_name":"q' || any_value(part) // 2 || '","display_name":"d' || any_value(part) // 2 || '","type_spelling":"' || max(type) || '","result_type":"' || max(result) || '"}') AS signature_hash
FROM good WHERE usr NOT IN (SELECT usr FROM late) GROUP BY usr""")
def symbol_merge(spark: SparkSession, sf: str) -> DataFrame:
    merged = symbols.merge_symbols(_records(spark, sf), "unit")[0]
    return merged.select("stable_usr", "kind", "type_spelling", "result_type", F.size("locations").cast("long").alias("n_places"), F.col("locations")[0]["file"].alias("first_file"), "documentation", "signature_hash")


@query(_UNITS_SQL + "SELECT usr AS stable_usr, sum(n)::BIGINT AS dropped_locations FROM dropped GROUP BY usr")
def symbol_conflicts(spark, sf):
    return symbols.merge_symbols(_records(spark, sf), "unit")[1].select("stable_usr", F.col("dropped_locations").cast("long").alias("dropped_locations"))


@query(_UNITS_SQL + "SELECT (SELECT sum(s_suppkey) FROM supplier)::BIGINT AS diagnostic_count, (SELECT sum(s_nationkey) FROM supplier)::BIGINT AS error_count, ((SELECT count(*) FROM supplier) + (SELECT sum(n) FROM dropped))::BIGINT AS unidentified_count")
def unit_counts(spark, sf):
    """Suppliers as units with counts of their own."""
    manifests = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("diagnostic_count"), F.col("s_nationkey").alias("error_count"), F.lit(1).alias("unidentified_count"))
    found = symbols.unit_counts(manifests, symbols.merge_symbols(_records(spark, sf), "unit")[1])
    return found.select(*[F.col(c).cast("long").alias(c) for c in found.columns])


# Records written and read back


@query("""
SELECT 'p' || p_partkey AS file, -1 AS item, upper(sha1('u' || p_partkey)) AS documentation_id, 'Outer::Inner::' || p_name AS qualified_name, CASE WHEN p_size % 2 = 0 THEN 'class' ELSE 'struct' END AS kind,
  CASE WHEN p_size % 2 = 0 THEN 'class' ELSE 'struct' END || ' Outer::Inner::' || p_name || '<typename T>' AS signature, p_type || chr(10) || p_brand AS documentation, 1::BIGINT AS n_places, 2::BIGINT AS n_members FROM part
UNION ALL SELECT 'p' || p_partkey, 0, upper(sha1('f' || p_partkey)), p_name || '::get' || p_size, 'method', 'int ' || p_name || '::get' || p_size || '(float,T)', NULL, 2, 0 FROM part""")
def documentation_blocks(spark, sf):
    """Each part as a documentation record with a template parameter, two members and a function."""
    p = dealt(table(spark, sf, "part"))
    text = F.format_string(
        "---\nUSR: '%s'\nName: '%s'\nNamespace:\n  - Type: Namespace\n    Name: 'Inner'\n  - Name: Outer\nDescription:\n  - Kind: FullComment\n    Children:\n      - Kind: Paragraph\n        Children:\n          - Text: ' %s'\n      - Kind: Text\n        Text: \"%s\"\n"
        "DefLocation:\n  LineNumber: %d\n  Filename: 'a.h'\nTagType: %s\nTemplate:\n  Params:\n    - Contents: 'typename T'\nMembers:\n  - Type:\n      Name: 'int'\n    Name: 'one'\n    Access: Private\n  - Name: 'two'\n    Type:\n      QualName: 'std::x'\n"
        "ChildFunctions:\n  - USR: '%s'\n    Name: 'get%d'\n    Parent:\n      USR: '%s'\n      Name: '%s'\n    Location:\n      - LineNumber: 3\n        Filename: 'a.h'\n    DefLocation:\n      LineNumber: 4\n      Filename: 'a.cpp'\n    IsMethod: true\n    Params:\n      - Type:\n          Name: float\n        Name: x\n      - Type:\n          Name: T\n        Name: y\n    ReturnType:\n      Type:\n        Name: 'int'\n...\n",
        F.upper(F.sha1(F.concat(F.lit("u"), "p_partkey").cast("binary"))), "p_name", "p_type", "p_brand", F.col("p_size") + 1, F.when(F.col("p_size") % 2 == 0, "Class").otherwise("Struct"), F.upper(F.sha1(F.concat(F.lit("f"), "p_partkey").cast("binary"))),
        "p_size", F.upper(F.sha1(F.concat(F.lit("u"), "p_partkey").cast("binary"))), "p_name",
    )
    found = blocks.documented_symbols(p.select(F.concat(F.lit("p"), "p_partkey").alias("path"), text.alias("text")))
    return found.select("file", "item", "documentation_id", "qualified_name", "kind", "signature", "documentation", F.size("locations").cast("long").alias("n_places"), F.size("members").cast("long").alias("n_members"))


def _rules(spark, sf):
    """Parts as module rules: a guarded list, a verbatim name, a call of a method; every eleventh never ends a string."""
    text = F.concat(
        F.lit('public class M'), F.col("p_partkey").cast("string"), F.lit(' : ModuleRules // "no"\n{\n  if ((Target.Platform == UnrealTargetPlatform.Win64) && (A('), F.col("p_size").cast("string"),
        F.lit(')))\n  {\n    PublicDependencyModuleNames.AddRange(new List<string>(new[] { "Core", @"B'), F.col("p_size").cast("string"), F.lit('" }));\n  }\n'),
        F.when(F.col("p_partkey") % 3 == 0, F.lit("  PrivateDependencyModuleNames.AddRange(Names(1, (2)));\n")).otherwise(F.lit('  PrivateDependencyModuleNames.Add("P");\n')),
        F.when(F.col("p_partkey") % 11 == 0, F.lit('  var s = "open;\n')).otherwise(F.lit("  var c = '\"';\n")), F.lit("}\n"),
    )
    return dealt(table(spark, sf, "part")).select(F.concat(F.lit("p"), "p_partkey").alias("path"), text.alias("text"))


_GUARD_SQL = "'((platform == Win64) && (A(' || p_size || ')))'"


@query(f"""
WITH p AS (SELECT 'p' || p_partkey AS path, 'M' || p_partkey AS module, p_size, p_partkey FROM part)
SELECT path, module, 'Core' AS name, 'public' AS visibility, {_GUARD_SQL} AS condition, 5 AS line FROM p WHERE p_partkey % 11 <> 0
UNION ALL SELECT path, module, 'B' || p_size, 'public', {_GUARD_SQL}, 5 FROM p WHERE p_partkey % 11 <> 0
UNION ALL SELECT path, module, 'P', 'private', NULL, 7 FROM p WHERE p_partkey % 11 <> 0 AND p_partkey % 3 <> 0
UNION ALL SELECT path, NULL, NULL, NULL, NULL, NULL FROM p WHERE p_partkey % 11 = 0""")
def module_dependencies(spark, sf):
    return lexing.module_rules(_rules(spark, sf))


@query("""
SELECT 'p' || p_partkey AS path, CASE WHEN p_partkey % 11 = 0 THEN 'UNTERMINATED_TOKEN' ELSE 'DYNAMIC_DEPENDENCY_EXPRESSION' END AS diagnostic, CASE WHEN p_partkey % 11 = 0 THEN 8 ELSE 7 END AS line, p_partkey % 11 <> 0 AS readable
FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 3 = 0""")
def module_diagnostics(spark, sf):
    return code.module_diagnostics(_rules(spark, sf))


@query("""
SELECT 'p' || p_partkey AS path, 'UCLASS' AS macro, 3 AS declaration_line, 'AThing' || p_size AS symbol_name, 'Blueprintable,DisplayName,Deep' AS specifiers, p_type || ', (' || p_brand AS display FROM part WHERE p_partkey % 7 <> 0
UNION ALL SELECT 'p' || p_partkey, 'UPROPERTY', 6, 'Count', 'EditAnywhere,Category', NULL FROM part WHERE p_partkey % 7 <> 0""")
def header_annotations(spark, sf):
    """Parts as headers with nested arguments; every seventh never closes its macro."""
    header = F.concat(
        F.lit('#define UCLASS(...)\nUCLASS(Blueprintable, meta=(DisplayName="'), "p_type", F.lit(", ("), "p_brand", F.lit('", Deep))\nclass CORE_API AThing'), F.col("p_size").cast("string"), F.lit(" : public AActor\n{\n"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit("  UFUNCTION(Never, (\n")).otherwise(F.lit('  UPROPERTY(EditAnywhere, Category="X") /* UPROPERTY() */\n  TMap<int, float> Count = F(3);\n')), F.lit("};\n"),
    )
    found = lexing.annotations(dealt(table(spark, sf, "part")).select(F.concat(F.lit("p"), "p_partkey").alias("path"), header.alias("text")))
    return found.select("path", "macro", "declaration_line", "symbol_name", F.array_join("specifiers", ",").alias("specifiers"), F.col("metadata")["DisplayName"].alias("display"))


@query("SELECT 'd' || doc_id AS stable_usr, coalesce(lang, '') AS type_spelling, '/r/' || coalesce(source, 'none') AS file, doc_id + 1 AS line, sha256(text) AS text_sha256 FROM documents WHERE text IS NOT NULL")
def extraction_streams(spark, sf):
    """Documents written as extraction streams, each with its manifest first, and read back: texts stand where documentation does."""
    docs = table(spark, sf, "documents").where("text is not null")
    n = max(8, docs.rdd.getNumPartitions())
    none, whole = F.lit(None).cast("string"), lambda c: F.col(c).cast("int")
    record = F.struct(
        F.lit("symbol").alias("type"), F.lit("variable").alias("kind"), F.concat(F.lit("d"), "doc_id").alias("usr"), F.lit("n").alias("name"), F.lit("n").alias("display_name"), F.lit("q::n").alias("qualified_name"), none.alias("owner_usr"),
        F.lit(True).alias("is_definition"), F.concat(F.lit("/r/"), F.coalesce("source", F.lit("none"))).alias("file"), (whole("doc_id") + 1).alias("start_line"), F.lit(1).alias("start_column"), (whole("doc_id") + 1).alias("end_line"),
        F.lit(1).alias("end_column"), F.coalesce("lang", F.lit("")).alias("type_spelling"), F.lit("").alias("result_type"), F.col("text").alias("documentation"),
    )
    rows = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("part"), F.lit(1).alias("later"), F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))
    head = F.to_json(F.struct(F.lit("manifest").alias("type"), F.lit(1).alias("schema_version"), F.lit("1").alias("libclang"), F.lit(0).alias("diagnostic_count"), F.lit(0).alias("error_count")))
    heads = rows.select("part").distinct().select("part", F.lit(0).alias("later"), head.alias("value"))
    path = new_path(spark, "streams")
    rows.unionByName(heads).repartition("part").sortWithinPartitions("part", "later").select("part", "value").write.partitionBy("part").text(path)
    read = extraction.extraction_records(extraction.stream_source.lines(spark, path, rangeBytes=1 << 20), ["/r"]).where("type = 'symbol'")
    return read.select(F.col("usr").alias("stable_usr"), "type_spelling", "file", F.col("start_line").cast("long").alias("line"), F.sha2("documentation", 256).alias("text_sha256"))


@query("""
SELECT 'orders' AS table_name, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders UNION ALL SELECT 'customers', count(*), sum(c_custkey)::BIGINT FROM customer""")
def committed_build(spark, sf):
    """Two tables written with a commit each, replayed, marked as one build and read by its mark."""
    root, plan = new_path(spark, "build"), "plan"
    tables = {"orders": table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "customers": table(spark, sf, "customer").select("c_custkey", "c_name")}
    for name, df in [*tables.items(), ("orders", tables["orders"].repartition(3))]:
        builds.write_table(df, root, name, plan)
    builds.complete(spark, root, plan, list(tables))
    sums = [builds.read_table(spark, root, name, plan).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys")) for name, key in (("orders", "o_orderkey"), ("customers", "c_custkey"))]
    return sums[0].unionByName(sums[1])


# Indexes


@query()
def vector_cells(spark, sf):
    """The 20 nearest vectors of each whose id is divisible by 20, among the cells that it probes."""
    rows = table(spark, sf, "embeddings")
    return cells.search_many(spark, cells.build(rows, "vec_id"), rows.where("vec_id % 20 = 0"), "vec_id").select(F.col("query").alias("vec_id"), F.col("key").alias("neighbour"), F.round("score", 9).alias("score"), "rank")


@query()
def vector_cells_recall(spark, sf):
    """What a search of a few cells finds of the 20 nearest vectors of 100 probes, and the share of all vectors that it reads."""
    rows = table(spark, sf, "embeddings")
    return cells.recall(spark, cells.build(rows, "vec_id"), rows.orderBy(F.xxhash64("vec_id")).limit(100), "vec_id")


_WORDS = "the of and"


@query("""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t, generate_subscripts(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 1) AS pos FROM documents),
w AS (SELECT doc_id, pos, least(max(pos) FILTER (t = 'the') OVER o, max(pos) FILTER (t = 'of') OVER o, max(pos) FILTER (t = 'and') OVER o) AS begin,
  max(pos) FILTER (t = 'the') OVER o IS NOT NULL AND max(pos) FILTER (t = 'of') OVER o IS NOT NULL AND max(pos) FILTER (t = 'and') OVER o IS NOT NULL AS whole FROM p WHERE t IN ('the', 'of', 'and')
  WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT doc_id, pos, begin, lag(begin) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM w WHERE whole)
SELECT doc_id, round(sum(1.0::DOUBLE / (pos - begin + 1)), 6) AS score FROM s WHERE before IS NULL OR begin > before GROUP BY doc_id ORDER BY sum(1.0::DOUBLE / (pos - begin + 1)) DESC, doc_id LIMIT 50""")
def fts_ranked(spark, sf):
    """The first 50 documents by cover density, from blocks of postings whose bound may reach them."""
    path = new_path(spark, "fts")
    ranked.write_index(dealt(table(spark, sf, "documents")).where("doc_id is not null"), path, "doc_id", only=_WORDS.split())
    return ranked.top_ranked(spark, path, _WORDS, "doc_id", 50)[0].select("doc_id", F.round("score", 6).alias("score"))


# Streams

_LEASE_MS, _DELAY_MS, _MOST = 36 * 3_600_000, 3_600_000, 6
_LEASE_SQL = f"""
WITH RECURSIVE m AS (
  SELECT 'u' || user_id AS job_id, ts AS moment, event_id AS id, 'a' || event_id % 2 AS agent, CASE WHEN event_type IN ('signup', 'purchase') THEN 'claim' WHEN event_type = 'error' AND event_id % 9 = 0 THEN 'done' ELSE 'beat' END AS kind,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
walk AS (
  SELECT job_id, 0::BIGINT AS i, NULL::TIMESTAMP AS moment, NULL::BIGINT AS id, NULL::VARCHAR AS agent, NULL::VARCHAR AS kind, 'queued' AS status, 0 AS attempt, NULL::VARCHAR AS holder, NULL::TIMESTAMP AS expires, TIMESTAMP '1970-01-01' AS available,
    NULL::VARCHAR AS result, false AS ended, NULL::TIMESTAMP AS ended_at, NULL::VARCHAR AS ended_by, NULL::VARCHAR AS ended_as, 0 AS ended_attempt FROM m WHERE i = 1
  UNION ALL
  SELECT job_id, i, moment, id, agent, kind,
    CASE WHEN claims THEN 'running' WHEN mine AND kind = 'done' THEN 'succeeded' ELSE status END, CASE WHEN claims THEN attempt + 1 ELSE attempt END, CASE WHEN claims THEN agent WHEN mine AND kind = 'done' THEN NULL ELSE holder END,
    CASE WHEN claims OR (mine AND kind = 'beat') THEN moment + INTERVAL {_LEASE_MS // 3_600_000} HOUR WHEN mine AND kind = 'done' THEN NULL ELSE expires END, available,
    CASE WHEN claims THEN 'claimed' WHEN kind = 'claim' THEN CASE WHEN mine THEN 'repeated' ELSE 'refused' END WHEN NOT mine THEN 'lease_lost' WHEN kind = 'beat' THEN 'extended' ELSE 'succeeded' END, ended, ended_at, ended_by, ended_as, ended_attempt
  FROM (SELECT *, status = 'running' AND holder = agent AS mine, kind = 'claim' AND status = 'queued' AND available <= moment AS claims FROM (
    SELECT w.job_id, m.i, m.moment, m.id, m.agent, m.kind, w.attempt, w.status = 'running' AND w.expires <= m.moment AS ended, w.expires AS ended_at, w.holder AS ended_by, CASE WHEN w.attempt < {_MOST} THEN 'queued' ELSE 'failed' END AS ended_as, w.attempt AS ended_attempt,
      CASE WHEN w.status = 'running' AND w.expires <= m.moment THEN CASE WHEN w.attempt < {_MOST} THEN 'queued' ELSE 'failed' END ELSE w.status END AS status, CASE WHEN w.status = 'running' AND w.expires <= m.moment THEN NULL ELSE w.holder END AS holder,
      CASE WHEN w.status = 'running' AND w.expires <= m.moment THEN NULL ELSE w.expires END AS expires, CASE WHEN w.status = 'running' AND w.expires <= m.moment THEN w.expires + INTERVAL 1 HOUR ELSE w.available END AS available
    FROM walk w JOIN m ON m.job_id = w.job_id AND m.i = w.i + 1))),
last AS (SELECT w.* FROM walk w JOIN m USING (job_id, i) WHERE m.i = m.n)
SELECT job_id, moment AS "at", id, agent AS agent_id, kind, attempt, result, CASE WHEN result NOT IN ('refused', 'lease_lost', 'succeeded') THEN expires END AS lease_expires_at FROM walk WHERE i > 0
UNION ALL SELECT job_id, ended_at, NULL, ended_by, 'expire', ended_attempt, ended_as, NULL FROM walk WHERE ended
UNION ALL SELECT job_id, expires, NULL, holder, 'expire', attempt, CASE WHEN attempt < {_MOST} THEN 'queued' ELSE 'failed' END, NULL FROM last WHERE status = 'running'
"""


@query(_LEASE_SQL)
def lease_stream(spark, sf):
    """Events as messages of two agents about each user's job, through a stream with event-time timers until all leases have ended."""
    kind = F.when(F.col("event_type").isin("signup", "purchase"), "claim").when((F.col("event_type") == "error") & (F.col("event_id") % 9 == 0), "done").otherwise("beat")
    messages = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), F.concat(F.lit("a"), F.col("event_id") % 2).alias("agent_id"), kind.alias("kind"), F.lit(None).cast("int").alias("attempt"))
    rows = leases.run_to_end(spark, messages, lambda stream: leases.lease_stream(stream, _LEASE_MS, _DELAY_MS, _MOST, "1 hour"), F.lit("2100-01-01").cast("timestamp"))
    return rows.where("job_id is not null")


# Collections that claim, delete and forget

_CLAIM, _OTHER = "a" * 64, "b" * 64
_HELD_SQL = f"""g AS (SELECT o_orderkey AS id, o_custkey AS project_id, CASE o_orderstatus WHEN 'F' THEN 'superseded' WHEN 'O' THEN 'active' ELSE 'failed' END AS status, o_orderdate AS published_at, o_orderkey % 7 AS publication_version,
    CASE o_orderkey % 5 WHEN 1 THEN '{_CLAIM}' WHEN 2 THEN '{_OTHER}' END AS gc_claim_hash, CASE WHEN o_orderkey % 3 > 0 THEN sha256(o_orderpriority) END AS manifest_hash FROM orders),
  r AS (SELECT *, row_number() OVER (PARTITION BY project_id, status IN ('active', 'superseded') ORDER BY published_at DESC, id DESC) AS k FROM g),
  free AS (SELECT * FROM r WHERE ((status = 'superseded' AND k > 2) OR status = 'failed') AND published_at < TIMESTAMP '1997-01-01' - INTERVAL 30 DAY AND (gc_claim_hash IS NULL OR gc_claim_hash = '{_CLAIM}'))"""


def _held(spark, sf):
    """Orders as generations of a customer each, of which two collections have claimed some; two thirds have a manifest."""
    id, status = F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", "superseded").when(F.col("o_orderstatus") == "O", "active").otherwise("failed")
    digest = F.when(id % 3 > 0, F.sha2("o_orderpriority", 256))
    rows = table(spark, sf, "orders").select(
        id.alias("id"), F.col("o_custkey").alias("project_id"), status.alias("status"), F.col("o_orderdate").alias("published_at"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderdate").alias("validated_at"), (id % 7).alias("publication_version"),
        F.when(id % 5 == 1, _CLAIM).when(id % 5 == 2, _OTHER).alias("gc_claim_hash"), F.when((id % 5).isin(1, 2), F.col("o_orderdate")).alias("gc_claimed_at"), F.when(digest.isNotNull(), F.concat(F.lit("store/"), id)).alias("manifest_uri"), digest.alias("manifest_hash"),
    )
    free = generations.retention(rows, rows.where("false").select(F.col("id").alias("generation_id")), F.lit("1997-01-01").cast("timestamp"), limit=1 << 30, claim=_CLAIM)
    return rows, stash(free, "candidates")


@query(f"""WITH {_HELD_SQL}
SELECT g.id, g.status, g.publication_version + CASE WHEN free.id IS NOT NULL AND g.gc_claim_hash IS NULL THEN 1 ELSE 0 END AS publication_version, CASE WHEN free.id IS NOT NULL THEN '{_CLAIM}' ELSE g.gc_claim_hash END AS gc_claim_hash FROM g LEFT JOIN free ON free.id = g.id""")
def collection_claims(spark, sf):
    """Claims of a collection that takes its own ones up again and leaves those of another."""
    rows, free = _held(spark, sf)
    return generations.claimed(rows, free, _CLAIM, F.lit("1997-01-01").cast("timestamp")).select("id", "status", "publication_version", "gc_claim_hash")


@query(f"""WITH {_HELD_SQL},
  d AS (SELECT id, 'store/' || id AS manifest_uri, sha256('{{"action":"gc-artifact-delete","generation_id":"' || id || '","manifest_hash":"' || manifest_hash || '","operation_id":"op"}}') AS idempotency_key FROM free WHERE manifest_hash IS NOT NULL)
SELECT id::VARCHAR AS id, manifest_uri, idempotency_key, sha256(manifest_uri || idempotency_key) AS receipt_hash FROM d""")
def collection_receipts(spark, sf):
    """Receipts for the manifests of all that a collection holds, asked for in tasks."""
    deletions = generations.artifact_deletions(_held(spark, sf)[1], "op")
    return generations.delete_artifacts(deletions, _deleted).select("id", "manifest_uri", "idempotency_key", "receipt_hash")


def _deleted(id, uri, digest, key):
    return hashlib.sha256(f"{uri}{key}".encode()).hexdigest()


@query(f"""WITH {_HELD_SQL} SELECT id, status FROM g WHERE id NOT IN (SELECT id FROM free WHERE manifest_hash IS NULL OR id % 2 = 0)""")
def collection_rest(spark, sf):
    """What is left of the generations when the even ones' manifests have their receipts and the odd ones' don't."""
    rows, free = _held(spark, sf)
    receipts = generations.delete_artifacts(generations.artifact_deletions(free, "op").where("id % 2 = 0"), _deleted)
    now = generations.claimed(rows, free, _CLAIM, F.lit("1997-01-01").cast("timestamp"))
    return generations.collected(now, free, stash(receipts, "receipts"), _CLAIM).select("id", "status")
