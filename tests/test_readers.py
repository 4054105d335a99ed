"""Documentation records, scans with diagnostics, line streams, builds with a commit."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import symbols
from lodestone.sources import blocks, builds, code, extraction, lexing, stream_source
from lodestone.validate import ValidationError

ID = "0123456789ABCDEF0123456789ABCDEF0123456"
RECORD = f"""---
USR: '{ID}0'
Name: 'Box'
Namespace:
  - Type: Namespace
    Name: 'Inner'
  - Name: Outer
Description:
  - Kind: FullComment
    Children:
      - Text: 'first'
        Children:
          - Text: " second: it's"
      - Text: ''
  - Text: 'It''s third'
DefLocation:
  LineNumber: 7
  Filename: 'a.h'
TagType: Class
Template:
  Params:
    - Contents: 'typename T'
    - Contents: 'int N'
Members:
  - Name: 'one'
    Type:
      Name: 'int'
      QualName: 'std::int'
    Access: Private
ChildFunctions:
  - USR: '{ID}1'
    Name: 'Box'
    Parent:
      USR: '{ID}0'
      QualName: 'Outer::Inner::Box'
      Name: 'Box'
  - USR: '{ID}2'
    Name: '~Box'
  -
    USR: '{ID}3'
    Name: 'run'
    IsMethod: true
    Namespace:
      - Name: 'N'
    Location:
      - LineNumber: 3
        Filename: 'a.h'
      - LineNumber: 2
        Filename: 'b.h'
    DefLocation:
      LineNumber: 4
      Filename: 'a.cpp'
    Params:
      - Type:
          Name: 'float'
    ReturnType:
      Type:
        Name: 'T'
..."""


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_records_with_functions_members_and_parameters(spark):
    rows = {r["item"]: r for r in blocks.documented_symbols(files(spark, ("y", RECORD))).collect()}
    root = rows[-1]
    assert (root.qualified_name, root.kind, root.signature) == ("Outer::Inner::Box", "class", "class Outer::Inner::Box<typename T,int N>")
    assert root.documentation == "first\nsecond: it's\nIt's third" and [tuple(p) for p in root.locations] == [("definition", "a.h", 7)]
    assert [tuple(m) for m in root.members] == [("one", "std::int", "private")] and root.stable_usr == f"clang-doc-sha1:{ID.lower()}0"
    assert [(rows[i].kind, rows[i].qualified_name) for i in range(3)] == [("constructor", "Outer::Inner::Box::Box"), ("destructor", "~Box"), ("method", "N::run")]
    assert rows[0].owner_usr == root.stable_usr and rows[2].signature == "T N::run(float)" and rows[2].documentation is None
    assert [tuple(p) for p in rows[2].locations] == [("declaration", "a.h", 3), ("declaration", "b.h", 2), ("definition", "a.cpp", 4)]
    named = spark.createDataFrame([("x",)], "stable_usr string").withColumns({"documentation": F.lit(None).cast("string")})
    assert symbols.unmatched_documentation(named, blocks.documentation_records(files(spark, ("y", RECORD)))).count() == 4


@pytest.mark.parametrize("text", [
    None, "", " USR: 1", "USR: 'a", "USR 'a'", "A: 1\nA: 2", "A:\n   B: 1", "A: 1\n  B: 2", "A:\n\tB: 1", "A: &x", "- A: 1\n- A:", "A:\n  - B: 1\n  C: 2", "A: \"\\x\"", f"USR: '{ID}0'", f"Name: x\nUSR: {ID.lower()}0",
    f"USR: '{ID}0'\nName: 12", f"USR: '{ID}0'\nName: x\nDefLocation:\n  LineNumber: 0\n  Filename: a", f"USR: '{ID}0'\nName: x\nMembers:\n  - Name: m", "A:\n" + "".join("  " * i + "A:\n" for i in range(1, 40)),
])
def test_malformed_records_raise(spark, text):
    try:
        list(blocks.Leaves.func().eval(text))
    except blocks.RecordError:
        return
    with pytest.raises(Exception):  # well formed, but not a record
        blocks.documented_symbols(files(spark, ("y", text))).collect()


def test_module_rules_in_depth(spark):
    good = 'class A : ModuleRules { /* " */ A() { PublicDependencyModuleNames.AddRange(new List<string>(new[] { "B", @"C" })); if (x("a")) { if (Target.Configuration != UnrealTargetConfiguration.Test) {\n DynamicallyLoadedModuleNames.Add((("D"))); } } PrivateDependencyModuleNames.AddRange(Names(1, (2))); } }'
    broken = [("s", 'class A : ModuleRules { x = "open'), ("v", 'class A : ModuleRules { x = @"a""; }'), ("c", "class A : ModuleRules { /* }"), ("b", "class A : ModuleRules { PublicDependencyModuleNames.Add("), ("i", "class A : ModuleRules { if (x { }"), ("n", 'class A : ModuleRules { PublicDependencyModuleNames.Add("a b"); }'), ("m", "class A {}"), ("0", None)]
    rows = files(spark, ("good", good), *broken)
    got = code.module_rules(rows).collect()
    assert {(r.name, r.visibility, r.condition, r.line) for r in got if r.path == "good"} == {("B", "public", None, 1), ("C", "public", None, 1), ("D", "dynamic", "(unsupported) && (configuration != Test)", 2)}
    assert {r.path for r in got if r.module is None} == {p for p, _ in broken}
    told = {(r.path, r.diagnostic, r.readable) for r in code.module_diagnostics(rows).collect()}
    assert told == {
        ("good", "UNSUPPORTED_CONDITION_EXPRESSION", True), ("good", "DYNAMIC_DEPENDENCY_EXPRESSION", True), ("s", "UNTERMINATED_TOKEN", False), ("v", "UNTERMINATED_TOKEN", False), ("c", "UNTERMINATED_TOKEN", False),
        ("b", "UNBALANCED", False), ("i", "UNBALANCED", False), ("n", "INVALID_MODULE_NAME", False), ("m", "NO_MODULE_RULES", False), ("0", "SOURCE_OUT_OF_BOUNDS", False),
    }
    with pytest.raises(ValidationError, match="8 files"):
        lexing.module_rules(rows, strict=True)


def test_annotations_in_depth(spark):
    good = '#if UCLASS(x)\nUFUNCTION(A, meta=(K="a, (b)", Deep))\nvirtual TMap<int, int> Run(int a, F f = F(1)) const;\nUPROPERTY(C="x\\"y")\nint Z[3] = {1};\n// UPROPERTY(\nstruct UCLASS2 {}; "UCLASS(";\nUCLASS()\nclass alignas_x API_X Last final_ {};'
    broken = [("p", "UCLASS((a)\nclass X {};"), ("d", "UPROPERTY(A=1, A=2)\nint x;"), ("q", 'UPROPERTY(A="x)\nint x;'), ("t", "UFUNCTION()\nint x;"), ("k", "UCLASS(1a)\nclass X {};")]
    rows = files(spark, ("good", good), *broken)
    got = {r.symbol_name: r for r in code.annotations(rows).collect()}
    assert {(n, r.macro, r.macro_line, r.declaration_line) for n, r in got.items()} == {("F", "UFUNCTION", 2, 3), ("Z", "UPROPERTY", 4, 5), ("final_", "UCLASS", 8, 9)}
    assert got["F"].specifiers == ["A", "K", "Deep"] and got["F"].metadata == {"K": "a, (b)"} and got["Z"].metadata == {"C": 'x"y'}
    assert {(r.path, r.diagnostic) for r in code.annotation_diagnostics(rows).collect()} == {("p", "UNBALANCED"), ("d", "INVALID_ARGUMENTS"), ("q", "UNTERMINATED_TOKEN"), ("t", "NO_DECLARATION"), ("k", "INVALID_ARGUMENTS")}


def test_an_open_quote_raises(spark):
    with pytest.raises(Exception, match="quote"):
        spark.createDataFrame([('cl "a b',)], "c string").select(code.command_arguments("c")).collect()


def test_ranges_read_every_line_once(spark, tmp_path):
    wanted = []
    for n in range(3):
        data, at = b"", 0
        for i in range(200):
            line = f"{n}/{i} " + "é" * (i % 37)
            end = b"\r\n" if i % 5 == 0 else b"\r" if i % 11 == 0 else b"\n" * (1 + i % 3)
            wanted.append((n, at, line))
            data += line.encode() + end
            at = len(data)
        (tmp_path / f"{n}.jsonl").write_bytes(data[:-1] if n == 2 else data)
    (tmp_path / "_hidden").write_bytes(b"no\n")
    (tmp_path / "empty").write_bytes(b"")
    for size in (1, 2, 7, 64, 1000, 1 << 20):  # each range by itself, as tasks read them
        source = stream_source._Batch({"path": str(tmp_path), "rangeBytes": size})
        rows = [r for part in source.partitions() for batch in source.read(part) for r in batch.to_pylist()]
        assert sorted((int(os.path.basename(r["path"])[0]), r["at"], r["line"]) for r in rows) == sorted(wanted)
    got = stream_source.lines(spark, str(tmp_path), rangeBytes=1000).collect()
    assert sorted((int(os.path.basename(r.path)[0]), r.at, r.line) for r in got) == sorted(wanted)
    for option in ({"mostBytes": 100}, {"mostLine": 10}):
        with pytest.raises(Exception, match="bytes"):
            stream_source.lines(spark, str(tmp_path), **option).collect()
    (tmp_path / "bad").write_bytes(b"\xff\xfe\n")
    with pytest.raises(Exception, match="UTF-8"):
        stream_source.lines(spark, str(tmp_path)).collect()


def test_streams_read_new_files_once(spark, tmp_path):
    where = tmp_path / "in"
    where.mkdir()
    for i in range(3):
        (where / f"{i}").write_text(f"a{i}\nb{i}\n")
        stream = stream_source.lines(spark, str(where), stream=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        stream.trigger(availableNow=True).start().awaitTermination()
        assert sorted(r.line for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(f"{x}{j}" for x in "ab" for j in range(i + 1))


HEAD = {"type": "manifest", "schema_version": 2, "libclang": "1", "diagnostic_count": 0, "error_count": 0}
SYMBOL = {
    "type": "symbol", "kind": "macro", "usr": "u", "name": "f", "display_name": "f", "qualified_name": "f", "owner_usr": None, "is_definition": False, "file": "/r/a.h", "start_line": 1, "start_column": 1, "end_line": 1, "end_column": 2,
    "type_spelling": "", "result_type": "", "documentation": "/** Says.\n *  More. */",
}
EDGE = {"type": "symbol_edge", "edge_type": "calls", "src_usr": "u", "dst_usr": "u", "file": "/r/a.h", "line": 1, "column": 1, "confidence": 1.0}
INCLUDE = {"type": "file_edge", "edge_type": "include", "src_file": "/r/a.h", "dst_file": "/r/b.h", "line": 1, "column": 1}


def test_extraction_rules(spark, tmp_path):
    def read(*records):
        (tmp_path / "x").write_text("\n".join(map(json.dumps, records)))
        return {k: v.collect() for k, v in extraction.read_extraction(spark, str(tmp_path / "x"), ["/r"]).items()}

    got = read(HEAD, SYMBOL, SYMBOL | {"qualified_name": "a/b"}, SYMBOL | {"usr": None}, SYMBOL | {"qualified_name": "operator/"}, EDGE, INCLUDE)
    assert {k: len(v) for k, v in got.items()} == {"manifest": 1, "symbols": 2, "unidentified": 2, "symbol_edges": 1, "file_edges": 1}
    assert got["symbols"][0].documentation == "Says.\n More." and got["symbols"][0].locations[0].kind == "definition"
    bad = [
        (SYMBOL, HEAD), (HEAD, HEAD), (HEAD | {"schema_version": 3},), (HEAD | {"extra": 1},), (HEAD, {k: v for k, v in SYMBOL.items() if k != "usr"}), (HEAD, SYMBOL | {"kind": "thing"}), (HEAD, SYMBOL | {"usr": ""}), (HEAD, SYMBOL | {"file": "/r/../x"}),
        (HEAD, SYMBOL | {"file": "r/a"}), (HEAD, SYMBOL | {"name": None}), (HEAD, EDGE | {"confidence": 2}), (HEAD, EDGE | {"edge_type": "inherits"}), (HEAD, EDGE | {"src_usr": "x" * 5000}), (HEAD, EDGE | {"line": 0}),
        (HEAD, INCLUDE | {"dst_file": "/x/b.h"}), (HEAD, INCLUDE | {"dst_file": "/r/./a.h"}), (HEAD | {"schema_version": 1}, EDGE), (HEAD, {"type": "other"}), (HEAD, SYMBOL | {"start_line": "1"}),
    ]
    for records in bad:
        with pytest.raises(Exception):
            read(*records)


def test_a_killed_task_and_a_replay_leave_one_build(spark, tmp_path):
    root, flag = str(tmp_path / "build"), str(tmp_path / "killed")
    rows = spark.range(1000).select("id", F.concat(F.lit("t"), "id").alias("t")).repartition(4)

    @F.udf("string")
    def dies(t):
        if t == "t777":
            raise RuntimeError("killed")
        return t

    with pytest.raises(Exception, match="killed"):
        builds.write_table(rows.withColumn("t", dies("t")), root, "a", "p")
    assert not [f for f in os.listdir(f"{root}/a") if f.startswith(("part-", "_"))] if os.path.exists(f"{root}/a") else True
    builds.write_table(rows, root, "a", "p")
    files_ = sorted(os.listdir(f"{root}/a"))
    open(f"{root}/a/part-orphan.parquet", "w").close()  # of an attempt that nobody heard of
    builds.write_table(rows.orderBy(F.desc("id")), root, "a", "p")
    assert set(files_) <= set(os.listdir(f"{root}/a"))
    for other, plan in ((rows.where("id > 3"), "p"), (rows, "q")):
        with pytest.raises(Exception, match="other rows"):
            builds.write_table(other, root, "a", plan)
    with pytest.raises(ValidationError):
        builds.read_table(spark, root, "a", "p")
    with pytest.raises(ValidationError, match="b"):
        builds.complete(spark, root, "p", ["a", "b"])
    builds.write_table(rows.limit(0), root, "b", "p")
    assert builds.complete(spark, root, "p", ["a", "b"]) == builds.complete(spark, root, "p", ["b", "a"])
    assert builds.read_table(spark, root, "a", "p").count() == 1000 and builds.read_table(spark, root, "b", "p").count() == 0
    assert sorted(map(tuple, builds.read_table(spark, root, "a", "p").collect())) == sorted(map(tuple, rows.collect()))
    assert not os.path.exists(flag)


def test_documents_beyond_their_limits_are_refused(spark):
    log = '<?xml version="1.0"?><!-- a --><log><logentry revision="7"><author>&lt;a&#65;</author><date>2024-01-02T03:04:05.000000Z</date><paths><path action="M" kind="file">/t</path></paths><msg>m</msg></logentry></log>'
    assert extraction.xml_fault(log) is None and extraction.xml_fault("\ufeff" + log) is None
    nested = lambda n: "<a>" * n + "</a>" * n
    bad = {
        "DTD_FORBIDDEN": '<!DOCTYPE log [<!ENTITY x "y">]><log>&x;</log>', "TOO_DEEP": nested(65), "DECLARATION_FORBIDDEN": "<a><![CDATA[x]]></a>", "TOO_MANY_NODES": "<a>" + "<b/>" * 200_000 + "</a>",
        "TOO_LARGE": "<a>" + "x" * (8 << 20) + "</a>",
    }
    assert extraction.xml_fault(nested(64)) is None
    for code_, text in bad.items():
        assert extraction.xml_fault(text) == code_
    for text in ("<a>", "<a></b>", "<a x=1/>", "<a x='1' x='2'/>", "<a>&nope;</a>", "<a>&#0;</a>", "", "<a/><b/>"):
        assert extraction.xml_fault(text) == "MALFORMED"
    rows = spark.createDataFrame([(log,), (bad["TOO_DEEP"],), (None,)], "xml string")
    assert extraction.from_log_xml(rows.limit(1)).first().author == "<aA"
    with pytest.raises(ValidationError, match="MISSING: 1, TOO_DEEP: 1"):
        extraction.from_log_xml(rows)
