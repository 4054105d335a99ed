"""Readers and scans on small texts."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import code, extraction
from lodestone.validate import ValidationError

BUILD = """
public class Core : ModuleRules // class Fake : ModuleRules
{
  public Core() {
    PublicDependencyModuleNames.AddRange(new string[] { "A", "B" });
    /* PrivateDependencyModuleNames.Add("No"); */
    if (Target.Platform == UnrealTargetPlatform.Win64) {
      PrivateDependencyModuleNames.Add("C"); // "D"
    }
  }
}
"""
HEADER = """#define UCLASS(...)
UCLASS(Blueprintable, meta=(DisplayName="A, b", Short))
class CORE_API AThing : public AActor
{
  UPROPERTY(EditAnywhere, Category="X")
  int Count = 3;
  // UFUNCTION()
  UFUNCTION(BlueprintCallable)
  void Run(int a);
};
"""


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_module_rules(spark):
    got = code.module_rules(files(spark, ("a", BUILD), ("b", "class X {}"))).collect()
    assert {(r.path, r.module, r.name, r.visibility, r.condition, r.line) for r in got} == {
        ("a", "Core", "A", "public", None, 5), ("a", "Core", "B", "public", None, 5), ("a", "Core", "C", "private", "(platform == Win64)", 8), ("b", None, None, None, None, None),
    }


def test_target_rules(spark):
    text = 'public class GameTarget : TargetRules { Type = TargetType.Editor; ExtraModuleNames.AddRange(new string[] { "G", "H" }); }'
    assert [tuple(r) for r in code.target_rules(files(spark, ("t", text))).collect()] == [("t", "GameTarget", "Editor", ["G", "H"])]


def test_descriptors_are_lenient(spark):
    text = '﻿{ // note\n "FileVersion": 3, "Modules": [{"Name": "M", "Type": "Runtime", "WhitelistPlatforms": ["Win64"],},], "Plugins": [{"Name": "P", "Enabled": true}], }'
    row = code.descriptors(files(spark, ("d", text))).first()
    assert (row.modules[0].name, row.modules[0].platforms, row.plugins[0].name, row.plugins[0].enabled) == ("M", ["Win64"], "P", True)


def test_annotations(spark):
    rows = {r.symbol_name: r for r in code.annotations(files(spark, ("h", HEADER))).collect()}
    assert set(rows) == {"AThing", "Count", "Run"}
    assert rows["AThing"].specifiers == ["Blueprintable", "DisplayName", "Short"] and rows["AThing"].metadata == {"DisplayName": "A, b"} and rows["AThing"].declaration_line == 3
    assert rows["Count"].specifiers == ["EditAnywhere", "Category"] and rows["Count"].metadata == {"Category": "X"} and (rows["Run"].macro, rows["Run"].declaration_line) == ("UFUNCTION", 9)


@pytest.mark.parametrize("line, want", [
    ('cl.exe /c "a b.cpp"', ["cl.exe", "/c", "a b.cpp"]), (r'x "a\"b" c\\d', ["x", 'a"b', r"c\\d"]), (r'x "a\\" b', ["x", "a\\", "b"]), ('x "" y', ["x", "", "y"]), ("", []),
])
def test_windows_command_lines(spark, line, want):
    assert spark.createDataFrame([(line,)], "c string").select(code.command_arguments("c")).first()[0] == want


def test_compile_commands(spark):
    rows = spark.createDataFrame([("d", "a\\b.cpp", "cl /Iinc -Dx=1 /FIpre.h /DY b.cpp", None)], "directory string, file string, command string, arguments array<string>")
    row = code.compile_commands(rows).first()
    assert (row.file, row.include_paths, row.forced_includes, row.definitions) == ("a/b.cpp", ["inc"], ["pre.h"], ["x=1", "Y"])


def test_documentation_records(spark):
    text = f"---\nUSR: '{'0A' * 20}'\nName: 'Box'\nDescription:\n  - Kind: FullComment\n    Text: ' A box.'\nTagType: Class\n"
    row = code.documentation_records(files(spark, ("y", text))).first()
    assert (row.documentation_id, row.name, row.text) == ("0A" * 20, "Box", "A box.")


LINES = [
    {"type": "manifest", "schema_version": 2, "libclang": "1", "diagnostic_count": 0, "error_count": 0},
    {"type": "symbol", "kind": "function", "usr": "u", "name": "f", "display_name": "f()", "qualified_name": "N::f", "is_definition": True, "file": "/r/a.h", "start_line": 1, "start_column": 1, "end_line": 1, "end_column": 5, "type_spelling": "", "result_type": "", "owner_usr": None, "documentation": None},
    {"type": "symbol", "kind": "function", "usr": None, "name": "g", "display_name": "g", "qualified_name": "g", "is_definition": False, "file": "/r/a.h", "start_line": 1, "start_column": 1, "end_line": 1, "end_column": 5, "type_spelling": "", "result_type": "", "owner_usr": None, "documentation": None},
    {"type": "symbol_edge", "edge_type": "calls", "src_usr": "u", "dst_usr": "v", "file": "/r/a.h", "line": 1, "column": 1, "confidence": 1.0},
    {"type": "file_edge", "edge_type": "include", "src_file": "/r/a.h", "dst_file": "/r/b.h", "line": 1, "column": 1},
]


def test_extraction_streams(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(map(json.dumps, LINES)))
    got = extraction.read_extraction(spark, str(path), ["/r/"])
    assert {k: v.count() for k, v in got.items()} == {"manifest": 1, "symbols": 1, "unidentified": 1, "symbol_edges": 1, "file_edges": 1}
    assert got["symbols"].first().locations[0].kind == "definition"
    with pytest.raises(ValidationError, match="below a root"):
        extraction.read_extraction(spark, str(path), ["/other"])
    path.write_text("{broken")
    with pytest.raises(Exception):
        extraction.read_extraction(spark, str(path), ["/r"])


def test_gold_suites(spark, tmp_path):
    key = "a" * 64
    path = tmp_path / "gold.json"
    path.write_text(json.dumps({"schema_version": 1, "suite_id": "s", "minimum_recall_at_20": 0.9, "cases": [{"case_id": "c", "language": "en", "query": "q", "relevant_chunk_keys": [key]}], "review": {"status": "pending"}}, indent=1))
    assert [tuple(r) for r in extraction.read_retrieval_gold(spark, str(path)).collect()] == [("s", 0.9, "c", "en", "q", key)]
    path.write_text(path.read_text().replace(key, "short"))
    with pytest.raises(ValidationError):
        extraction.read_retrieval_gold(spark, str(path))


def test_parameter_rows(spark):
    assert [tuple(r) for r in extraction.parameter_rows(spark, '[{"a": 1, "b": "x"}, {"a": 2, "b": null}]', "a:int,b:string").collect()] == [(1, "x"), (2, None)]


def test_parameter_values(spark):
    assert [tuple(r) for r in extraction.parameter_values(spark, '["a", null, "b"]').collect()] == [(0, "a"), (1, None), (2, "b")]
    with pytest.raises(Exception):
        extraction.parameter_values(spark, '["a"', "string").collect()


def test_commands_with_response_files(spark, monkeypatch):
    commands = spark.createDataFrame([(1, "/r", "a.cpp", "cl @x.rsp /DZ a.cpp")], "id int, directory string, file string, command string")
    texts = spark.createDataFrame([("/r/x.rsp", "/Iinc @y.rsp"), ("/r/y.rsp", "-DY")], "path string, text string")
    row = code.compile_commands(commands, texts, ["/r"]).first()
    assert (row.include_paths, row.definitions) == (["inc"], ["Y", "Z"])
    for limit, what in (("RESPONSE_FILES", "number"), ("ALL_BYTES", "bytes")):
        with monkeypatch.context() as m, pytest.raises(ValidationError, match=what):
            m.setattr(code, limit, 1)
            code.compile_commands(commands, texts, ["/r"])


def test_checkpoints_have_no_gaps(spark, tmp_path):
    add = lambda batch: spark.createDataFrame([(batch, "p")], "batch int, plan_hash string").write.mode("append").parquet(f"{tmp_path}/c")
    add(0), add(1)
    assert extraction.read_checkpoints(spark, f"{tmp_path}/c", "p").count() == 2
    with pytest.raises(ValidationError):
        extraction.read_checkpoints(spark, f"{tmp_path}/c", "other")
    add(3)
    with pytest.raises(ValidationError):
        extraction.read_checkpoints(spark, f"{tmp_path}/c", "p")


LOG = '<log><logentry revision="7"><author>ann</author><date>2024-01-02T03:04:05.000000Z</date><paths><path action="M" kind="file">/trunk/a</path></paths><msg>fix</msg></logentry></log>'
STATUS = '<status><target path="."><entry path="a.c"><wc-status item="modified" props="none" revision="7"/></entry></target></status>'


def test_version_control_documents(spark):
    xml = lambda text: spark.createDataFrame([(text,)], "xml string")
    log = extraction.from_log_xml(xml(LOG)).first()
    assert (log.revision, log.author, log.message, log.action, log.kind, log.path) == (7, "ann", "fix", "M", "file", "/trunk/a")
    assert tuple(extraction.from_status_xml(xml(STATUS)).first()) == ("a.c", "modified", "none", 7)
    with pytest.raises(ValidationError):
        extraction.from_log_xml(xml("<!DOCTYPE x>" + LOG)).count()


def test_comments_go_and_strings_stay(spark):
    row = files(spark, ("p", 'a "//x" // y\n/* z\n*/ b')).select(code.without_comments(F.col("text")).alias("c")).first()
    assert [x.rstrip() for x in row.c.split("\n")] == ['a "//x"', "", "   b"]
