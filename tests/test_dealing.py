"""Tables of one row group meet all cores where their rows cost much, each scan goes through a file once, and leaves are shuffled once."""

import pytest

from lodestone import storage
from lodestone.plans import catalog, catalog_index, catalog_readers  # noqa: F401
from lodestone.sources import blocks, lexing


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_any_size_are_dealt(spark, sf):
    parts = storage.table(spark, sf, "part")
    cores = spark.sparkContext.defaultParallelism
    assert storage.dealt(parts).rdd.getNumPartitions() == cores
    many = storage.dealt(parts, each=100)
    assert many.rdd.getNumPartitions() > cores and many.exceptAll(parts).isEmpty() and many.count() == parts.count()


def test_leaves_are_shuffled_once_and_not_written(spark, sf, monkeypatch):
    seen = {}
    kept = blocks.stash
    monkeypatch.setattr(blocks, "stash", lambda df, name: seen.setdefault(name, plan(df)) and kept(df, name))
    catalog.QUERIES["documentation_blocks"](spark, sf)
    assert list(seen) == ["records"]
    assert seen["records"].count("Exchange hashpartitioning") == 1 and "Exchange RoundRobinPartitioning" in seen["records"] and "Join" not in seen["records"].replace("lateral", "")


def test_records_of_functions_alone_have_no_symbol_and_bad_leaves_raise(spark):
    usr = "A" * 40
    rows = [("f", f"ChildFunctions:\n  - USR: '{usr}'\n    Name: 'g'"), ("r", f"USR: '{usr}'\nName: 'x'\nMembers:\n  - Name: 'm'\n    Type:\n      Name: 'int'\n  - Name: 'n'\n    Type:\n      Name: 'T'")]
    df = spark.createDataFrame(rows, "path string, text string")
    got = blocks.documented_symbols(df).collect()
    assert [(r.file, r["item"], [m.name for m in r.members], r.template_parameters, r.documentation) for r in got] == [("r", -1, ["m", "n"], [], None)]
    bad = spark.createDataFrame([("b", f"USR: '{usr}'\nName: 'x'\nDefLocation:\n  Filename: 'a'\n  LineNumber: 0")], "path string, text string")
    with pytest.raises(blocks.require.__globals__["ValidationError"], match="^lines: 1$"):
        blocks.documented_symbols(bad)


@pytest.mark.parametrize("name", ["module_dependencies", "module_diagnostics", "header_annotations"])
def test_scans_go_through_a_file_once_on_all_cores(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    assert plan(df).count("EvalPythonUDTF") == 1
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_module_rules_of_one_path_stay_apart(spark):
    one = "class A : ModuleRules { A() { PublicDependencyModuleNames.Add(\"B\"); } }"
    rows = [("p", one), ("p", one.replace("A", "C").replace("CddRange", "AddRange").replace(".Cdd", ".Add")), ("q", "class Q : ModuleRules { }"), (None, one)]
    got = lexing.module_rules(spark.createDataFrame(rows, "path string, text string")).collect()
    assert sorted((str(r.path), r.module, str(r.name)) for r in got) == [("None", "A", "B"), ("p", "A", "B"), ("p", "C", "B"), ("q", "Q", "None")]


def test_documents_in_one_row_group_are_cut_on_all_cores(spark, sf):
    assert catalog.QUERIES["chunk_split"](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["postings_df", "fts_all_terms"])
def test_postings_of_large_tables_are_made_on_all_cores(spark, sf, name, monkeypatch):
    monkeypatch.setattr(storage, "SMALL", 1)
    assert "Exchange RoundRobinPartitioning" in plan(catalog.QUERIES[name](spark, sf))
