"""Readers with fixed schemas: extraction streams, gold suites, vectors, JSON parameters, checkpoints, archives of XML."""

from __future__ import annotations

from functools import reduce
from xml.parsers import expat

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import schemas
from lodestone.operators.acl import under
from lodestone.operators.chunks import path_key
from lodestone.operators.evaluation import relation_hash
from lodestone.sources import stream_source
from lodestone.storage import stash
from lodestone.validate import ValidationError, require

KINDS = ("manifest", "symbol", "symbol_edge", "file_edge")


#: The fields that a record of each type has, no more and no fewer; kinds of symbols; limits of texts and places.
FIELDS = {
    "manifest": "type schema_version libclang diagnostic_count error_count",
    "symbol": "type kind usr name display_name qualified_name owner_usr is_definition file start_line start_column end_line end_column type_spelling result_type documentation",
    "symbol_edge": "type edge_type src_usr dst_usr file line column confidence", "file_edge": "type edge_type src_file dst_file line column",
}
SYMBOL_KINDS = ("namespace", "class", "struct", "union", "enum", "enumerator", "function", "method", "constructor", "destructor", "variable", "field", "parameter", "typedef", "type_alias", "macro", "concept")
LONGEST, LONGEST_NOTE, FURTHEST = 4096, 1 << 20, 10_000_000


def extraction_records(lines: DataFrame, roots: list[str]) -> DataFrame:
    """(path, at, the fields of any record) of lines (path, at, line), a finished table or a stream. A record that breaks a rule raises."""
    rows = lines.select("path", "at", F.from_json("line", schemas.EXTRACTION, {"mode": "FAILFAST"}).alias("r"), F.array_sort(F.json_object_keys("line")).alias("_keys")).select("path", "at", "_keys", "r.*")
    below = lambda c: reduce(Column.__or__, [under(path_key(F.col(c)), F.lit(root.rstrip("/"))) & (path_key(F.col(c)) != root.rstrip("/")) for root in roots])
    of = lambda kind, rule: (F.col("type") != kind) | F.coalesce(rule, F.lit(False))
    both = lambda *rules: reduce(Column.__and__, rules)
    filled = lambda *names: both(*[F.length(c).between(1, LONGEST) for c in names])
    absolute = lambda c: F.col(c).startswith("/") | F.col(c).rlike("^[A-Za-z]:[/\\\\]")
    keys = F.coalesce(*[F.when(F.col("type") == k, F.array(*map(F.lit, sorted(v.split())))) for k, v in FIELDS.items()])
    place = F.col("line").between(1, FURTHEST) & F.col("column").between(1, FURTHEST)
    texts = [F.col(c).isNotNull() for c in ("name", "display_name", "qualified_name", "type_spelling", "result_type", "is_definition")]
    rules = {
        "record type": F.col("type").isin(*KINDS), "fields": F.col("_keys") == keys,
        "manifest": of("manifest", F.col("schema_version").isin(1, 2) & (F.length("libclang") > 0) & (F.col("diagnostic_count") >= 0) & (F.col("error_count") >= 0)),
        "edge": of("symbol_edge", both(F.col("edge_type").isin(*schemas.EXTRACTED_EDGE_TYPES), F.col("confidence").between(0, 1), filled("src_usr", "dst_usr", "file"), place)),
        "edge of one end": of("symbol_edge", ~F.col("edge_type").isin("inherits", "overrides") | (F.col("src_usr") != F.col("dst_usr"))),
        "include": of("file_edge", both(F.col("edge_type") == "include", filled("src_file", "dst_file"), place, path_key(F.col("src_file")) != path_key(F.col("dst_file")))),
        "symbol": of("symbol", both(*texts, F.col("kind").isin(*SYMBOL_KINDS), *[F.col(c) >= 0 for c in ("start_line", "start_column", "end_line", "end_column")])),
        "identity": of("symbol", both(*[F.col(c).isNull() | (F.length(c) > 0) for c in ("usr", "owner_usr")])),
        "documentation": F.col("documentation").isNull() | ((F.length("documentation") <= LONGEST_NOTE) & ~F.contains(F.col("documentation"), F.lit("\0"))),
        "file below a root": both(*[F.col(c).isNull() | (absolute(c) & below(c)) for c in ("file", "src_file", "dst_file")]) & of("symbol", F.col("file").isNotNull()),
    }
    where = F.concat(F.col("path"), F.lit(" byte "), F.col("at").cast("string"), F.lit(": "))
    for name, rule in rules.items():
        rows = rows.where(F.when(F.coalesce(rule, F.lit(False)), True).otherwise(F.raise_error(F.concat(where, F.lit(name))).cast("boolean")))
    return rows.drop("_keys")


def note(text: Column) -> Column:
    """A comment without its marks: of each line those it begins and ends with; nothing but blanks is null."""
    line = lambda x: F.rtrim(F.regexp_replace(F.regexp_replace(x, r"\*/\s*$", ""), r"^\s*(?:///?|/\*\*?|\*)\s?", ""))
    return F.nullif(F.trim(F.array_join(F.transform(F.split(text, "\r?\n"), line), "\n")), F.lit(""))


def read_extraction(spark: SparkSession, path: str, roots: list[str], lines: DataFrame | None = None) -> dict[str, DataFrame]:
    """Extraction streams split by record type. A stream begins with its one manifest, and has edges in version 2 only; a
    malformed record, a file outside ``roots`` and a stream beyond its limits raise. Symbols without an identity, a name or a
    usable place, or with a path for a name, are set apart as ``unidentified``. ``lines`` (path, at, line) may come from elsewhere."""
    read = stash(extraction_records(stream_source.lines(spark, path) if lines is None else lines, roots), "records")
    heads = read.groupBy("path").agg(
        F.min_by("type", "at").alias("first"), F.count_if(F.col("type") == "manifest").alias("manifests"), F.max("schema_version").alias("version"), F.count_if(F.col("type").isin("symbol_edge", "file_edge")).alias("edges"),
        F.count(F.lit(1)).alias("n"),
    )
    require(heads, {"manifest first, and one": (F.col("first") == "manifest") & (F.col("manifests") == 1), "edges in version 2": (F.col("edges") == 0) | (F.col("version") == 2), "number of records": F.col("n") <= stream_source.MOST_RECORDS})
    symbols = read.where("type = 'symbol'")
    defined = F.col("is_definition") | (F.col("kind") == "macro")
    place = F.struct(F.when(defined, "definition").otherwise("declaration").alias("kind"), "file", "start_line", "start_column", "end_line", "end_column")
    named = (F.length("usr") > 0) & (F.length("name") > 0) & (F.length("display_name") > 0) & (F.length("qualified_name") > 0)
    path_like = F.regexp_replace("qualified_name", "operator/=?", "operator").rlike(r"[/\\]")
    ordered = (F.col("start_line") >= 1) & (F.col("start_column") >= 1) & ((F.col("end_line") > F.col("start_line")) | ((F.col("end_line") == F.col("start_line")) & (F.col("end_column") >= F.col("start_column"))))
    usable = F.coalesce(named & ~path_like & ordered, F.lit(False))
    identified = symbols.where(usable).select(
        F.col("usr").alias("stable_usr"), "qualified_name", "name", "display_name", "kind", "type_spelling", "result_type", F.array(place).alias("locations"), "owner_usr", note(F.col("documentation")).alias("documentation"),
        F.col("path").alias("unit"), "at",
    )
    return {
        "manifest": read.where("type = 'manifest'").select(F.col("path").alias("unit"), "schema_version", "libclang", "diagnostic_count", "error_count"),
        "symbols": identified, "unidentified": symbols.where(~usable),
        "symbol_edges": read.where("type = 'symbol_edge'").select("edge_type", "src_usr", "dst_usr", "confidence", "file", "line", "column"),
        "file_edges": read.where("type = 'file_edge'").select("edge_type", "src_file", "dst_file", "line", "column"),
    }


GOLD = "schema_version int, suite_id string, minimum_recall_at_20 double, cases array<struct<case_id:string,language:string,query:string,relevant_chunk_keys:array<string>>>, review struct<status:string,reviewer:string,approved_at:string,payload_sha256:string>"


def read_retrieval_gold(spark: SparkSession, path: str) -> DataFrame:
    """(suite_id, least, case_id, language, query, chunk_key): a row per relevant chunk."""
    suite = require(spark.read.schema(GOLD).option("multiLine", True).option("mode", "FAILFAST").json(path), {
        "schema version": F.col("schema_version") == 1, "minimum recall": F.col("minimum_recall_at_20").between(0.9, 1), "cases": F.size("cases") > 0,
        "keys": F.forall("cases", lambda c: (F.size(c["relevant_chunk_keys"]) > 0) & F.forall(c["relevant_chunk_keys"], lambda k: k.rlike("^[0-9a-f]{64}$"))),
    })
    cases = suite.select("suite_id", F.col("minimum_recall_at_20").alias("least"), F.explode("cases").alias("c"))
    return cases.select("suite_id", "least", "c.case_id", "c.language", "c.query", F.explode("c.relevant_chunk_keys").alias("chunk_key"))


def gold_edges(spark: SparkSession, path: str) -> DataFrame:
    """Expected symbol edges of a relation suite."""
    schema = "suite_id string, minimum_precision double, minimum_recall double, symbol_edges array<struct<expectation_id:string,edge_type:string,src_usr:string,dst_usr:string,file:string,line:int,column:int,confidence:double>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("symbol_edges").alias("e")).select("e.*")


def gold_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Expected symbols of a symbol suite."""
    symbol = T.StructType([T.StructField("expectation_id", T.StringType()), *schemas.SYMBOL.fields])
    schema = T.StructType([T.StructField("suite_id", T.StringType()), T.StructField("allowed_extra_kinds", T.ArrayType(T.StringType())), T.StructField("symbols", T.ArrayType(symbol))])
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("symbols").alias("s"), "allowed_extra_kinds").select("s.*", "allowed_extra_kinds")


def parameter_rows(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """The rows of a JSON array given as a parameter."""
    one = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", f"array<struct<{schema}>>", {"mode": "FAILFAST"}).alias("rows"))
    return one.select(F.inline("rows"))


def parameter_values(spark: SparkSession, text: str, kind: str = "string") -> DataFrame:
    """(place, value) of a JSON array of plain values given as a parameter."""
    one = spark.createDataFrame([(text,)], "j string").select(F.from_json("j", f"array<{kind}>", {"mode": "FAILFAST"}).alias("values"))
    return one.select(F.posexplode("values").alias("place", "value"))


def write_checkpoint(df: DataFrame, path: str, batch: int, plan_hash: str) -> str:
    """Stage output of one batch under ``batch=``, with the hash of its plan; the hash of its rows is written last, as the mark
    that it is whole, and returned. A batch that is there already with the same rows is left as it is; other rows raise."""
    spark, cols = df.sparkSession, sorted(df.columns)
    digest = relation_hash(df, *cols).first()["payload_hash"]
    marks = _marks(spark, path)
    if batch in marks:
        if marks[batch] != (plan_hash, digest):
            raise ValidationError(f"batch {batch} is there with other rows")
        return digest
    if batch != len(marks):
        raise ValidationError(f"batch {len(marks)} comes next")
    df.withColumn("plan_hash", F.lit(plan_hash)).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    spark.createDataFrame([(batch, plan_hash, digest, ",".join(cols))], MARK).coalesce(1).write.mode("append").json(f"{path}/_marks")
    return digest


MARK = "n int, plan string, rows string, cols string"


def _marks(spark: SparkSession, path: str) -> dict[int, tuple[str, str]]:
    try:
        return {r["n"]: (r["plan"], r["rows"]) for r in spark.read.schema(MARK).json(f"{path}/_marks").collect()}  # a row a batch
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}


def read_checkpoints(spark: SparkSession, path: str, plan_hash: str) -> DataFrame:
    """Stage output written as Parquet under ``batch=``; its batches must be 0..n-1 and of one plan. Where they have marks
    (``write_checkpoint``), the rows of each must have the hash that its mark says."""
    rows = spark.read.parquet(path)
    seen = rows.select("batch", "plan_hash").distinct().collect()
    if {r["plan_hash"] for r in seen} - {plan_hash} or sorted(r["batch"] for r in seen) != list(range(len(seen))):
        raise ValidationError("checkpoints of another plan, or with gaps")
    if marks := _marks(spark, path):
        found = relation_hash(rows, *sorted(c for c in rows.columns if c not in ("batch", "plan_hash")), by="batch")
        wrong = sorted(r["batch"] for r in found.collect() if r["batch"] in marks and marks[r["batch"]][1] != r["payload_hash"])  # a row a batch
        if wrong:
            raise ValidationError(f"batch {wrong[0]} is not what was written")
    return rows


#: Most bytes, levels and elements of a document.
XML_BYTES, XML_DEEPEST, XML_NODES = 8 << 20, 64, 200_000


def xml_fault(text: str, most: int = XML_BYTES, deepest: int = XML_DEEPEST, nodes: int = XML_NODES) -> str | None:
    """Why a document may not be read, by its events and without a tree: it ends at the first event beyond a limit."""
    if len(text.encode("utf-8", "surrogatepass")) > most:
        return "TOO_LARGE"
    parser, depth, seen, fault = expat.ParserCreate(), 0, 0, None

    def stop(code):
        nonlocal fault
        fault = code
        raise ValueError(code)

    def begin(name, attributes):
        nonlocal depth, seen
        depth, seen = depth + 1, seen + 1
        if depth > deepest or seen > nodes:
            stop("TOO_DEEP" if depth > deepest else "TOO_MANY_NODES")

    def end(name):
        nonlocal depth
        depth -= 1

    parser.StartElementHandler, parser.EndElementHandler = begin, end
    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = lambda *a: stop("DTD_FORBIDDEN")
    parser.StartCdataSectionHandler = lambda: stop("DECLARATION_FORBIDDEN")
    try:
        parser.Parse(text.removeprefix("\ufeff").encode("utf-8", "surrogatepass"), True)
    except (ValueError, expat.ExpatError):
        return fault or "MALFORMED"
    return None


def checked_xml(rows: DataFrame, column: str = "xml") -> DataFrame:
    """``rows`` whose documents are well formed, without a DTD, entities or sections of their own, and within the limits; others raise."""

    @F.pandas_udf("string")
    def fault(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "MISSING" if t is None else xml_fault(t))

    bad = rows.select(fault(column).alias("fault")).where("fault is not null").groupBy("fault").count().collect()  # a row a kind of fault
    if bad:
        raise ValidationError(", ".join(f"{r['fault']}: {r['count']}" for r in sorted(bad, key=lambda r: r["fault"])))
    return rows


LOG = "_revision long, author string, date string, msg string, paths struct<path: array<struct<_VALUE:string,_action:string,_kind:string>>>"
STATUS = "_path string, `wc-status` struct<_item:string,_props:string,_revision:long>"


def from_log_xml(rows: DataFrame, column: str = "xml") -> DataFrame:
    """(revision, author, date, message, action, kind, path) from log documents; ``checked_xml`` says which are refused."""
    safe = checked_xml(rows, column)
    entries = safe.select(F.explode(F.from_xml(column, f"logentry array<struct<{_struct(LOG)}>>").getField("logentry")).alias("e"))
    each = entries.select("e.*", F.explode_outer("e.paths.path").alias("p"))
    return each.select(F.col("_revision").alias("revision"), "author", F.to_timestamp("date").alias("date"), F.col("msg").alias("message"), F.col("p._action").alias("action"), F.col("p._kind").alias("kind"), F.col("p._VALUE").alias("path"))


def from_status_xml(rows: DataFrame, column: str = "xml") -> DataFrame:
    """(path, item, props, revision) from status documents."""
    safe = checked_xml(rows, column)
    entries = safe.select(F.explode(F.from_xml(column, f"target struct<entry: array<struct<{_struct(STATUS)}>>>").getField("target").getField("entry")).alias("e"))
    return entries.select(F.col("e._path").alias("path"), F.col("e.wc-status._item").alias("item"), F.col("e.wc-status._props").alias("props"), F.col("e.wc-status._revision").alias("revision"))


INFO = "_kind string, _path string, _revision long, url string, repository struct<root:string,uuid:string>, commit struct<_revision:long,author:string,date:string>"
DIFF = "_VALUE string, _item string, _kind string"


def from_info_xml(rows: DataFrame, column: str = "xml") -> DataFrame:
    """(kind, path, revision, url, root, uuid, commit_revision, author, date) from info documents."""
    safe = checked_xml(rows, column)
    e = safe.select(F.explode(F.from_xml(column, f"entry array<struct<{_struct(INFO)}>>").getField("entry")).alias("e"))
    return e.select(
        F.col("e._kind").alias("kind"), F.col("e._path").alias("path"), F.col("e._revision").alias("revision"), "e.url", "e.repository.root", "e.repository.uuid",
        F.col("e.commit._revision").alias("commit_revision"), "e.commit.author", F.to_timestamp("e.commit.date").alias("date"),
    )


def from_diff_xml(rows: DataFrame, column: str = "xml") -> DataFrame:
    """(path, item, kind) from documents of changed paths."""
    safe = checked_xml(rows, column)
    p = safe.select(F.explode(F.from_xml(column, f"paths struct<path: array<struct<{_struct(DIFF)}>>>").getField("paths").getField("path")).alias("p"))
    return p.select(F.col("p._VALUE").alias("path"), F.col("p._item").alias("item"), F.col("p._kind").alias("kind"))


def _struct(ddl: str) -> str:
    """Column DDL as fields of a struct."""
    schema = T.StructType.fromDDL(ddl)
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in schema.fields)
