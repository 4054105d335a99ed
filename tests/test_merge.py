"""Merging of units against a fold in plain Python, in the order of the units."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from lodestone.operators import symbols

RECORD = "unit int, at long, stable_usr string, qualified_name string, name string, display_name string, kind string, owner_usr string, type_spelling string, result_type string, locations array<struct<kind:string,file:string,start_line:int>>, documentation string"
#: Locale order of what the tests write: letters before case, accents after letters.
ORDER = ["a", "A", "á", "b", "B", "z", "Z"]


def fold(records):
    """Per-unit merges in record order, then units one after another: (symbols by identity, dropped locations)."""
    fields, filled = ("qualified_name", "name", "display_name", "kind", "owner_usr"), ("type_spelling", "result_type")
    clash = lambda a, b: any(a[f] != b[f] for f in fields) or any(a[f] and b[f] and a[f] != b[f] for f in filled)
    units, dropped = {}, {}
    for r in sorted(records, key=lambda r: (r["unit"], r["at"])):
        units.setdefault(r["unit"], {}).setdefault(r["stable_usr"], []).append(r)

    def merged(one, two):
        out = dict(two)
        for f in filled:
            out[f] = one[f] or two[f]
        return out

    whole, lost = {}, set()
    for unit in sorted(units):
        for usr, rows in units[unit].items():
            now, bad = None, False
            for r in rows:
                bad = bad or (now is not None and clash(now, r))
                if not bad:
                    notes = [x for x in ((now or {}).get("documentation"), r["documentation"]) if x is not None]
                    places = list((now or {}).get("locations", []))
                    places += [p for p in r["locations"] if p not in places]
                    now = (merged(now, r) if now else dict(r)) | {"documentation": max(notes, key=len) if notes else None, "locations": places}
            if bad:
                dropped[usr] = dropped.get(usr, 0) + sum(len(r["locations"]) for r in rows)
                continue
            if usr in lost:
                dropped[usr] = dropped.get(usr, 0) + len(now["locations"])
                continue
            if usr in whole and clash(whole[usr], now):
                dropped[usr] = dropped.get(usr, 0) + len(whole.pop(usr)["locations"]) + len(now["locations"])
                lost.add(usr)
                continue
            before = whole.get(usr)
            notes = [x for x in ((before or {}).get("documentation"), now["documentation"]) if x is not None]
            places = list((before or {}).get("locations", []))
            places += [p for p in now["locations"] if p not in places]
            best = min(notes, key=lambda n: (-len(n.encode("utf-16-le")), [ORDER.index(c) for c in n if c in ORDER])) if notes else None
            whole[usr] = (merged(before, now) if before else dict(now)) | {"documentation": best, "locations": places}
    return whole, dropped


def signature(r):
    return hashlib.sha256(json.dumps({k: r[k] for k in ("kind", "qualified_name", "display_name", "type_spelling", "result_type")}, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def test_units_merge_as_a_fold_in_their_order(spark):
    deal = random.Random(5)
    rows = []
    for i in range(600):
        usr = deal.randint(0, 60)
        odd = lambda other: deal.choice([other] * 14 + [other + "2"])
        rows.append({
            "unit": deal.randint(0, 5), "at": i, "stable_usr": f"u{usr}", "qualified_name": f"q{usr}", "name": odd("n"), "display_name": "d", "kind": odd("k") if usr % 3 else "k", "owner_usr": deal.choice([None] * 30 + ["o"]) if usr % 7 == 0 else None,
            "type_spelling": deal.choice(["", "T", "T", "T"]) if usr % 5 else deal.choice(["", "T", "S"] + ["T"] * 20), "result_type": deal.choice(["", "int"]),
            "locations": [("definition", deal.choice(["b", "B", "a"]), deal.randint(1, 4))], "documentation": deal.choice([None, "", "a", "A", "á", "b", "Z", "z"]),
        })
    df = spark.createDataFrame([tuple(r.values()) for r in rows], RECORD).repartition(4)
    got, ambiguous = symbols.merge_symbols(df, "unit", "at")
    want, dropped = fold(rows)
    found = {r.stable_usr: r for r in got.collect()}
    assert set(found) == set(want)
    for usr, r in found.items():
        w = want[usr]
        for f in ("qualified_name", "name", "display_name", "kind", "owner_usr", "type_spelling", "result_type", "documentation"):
            assert r[f] == w[f], (usr, f)
        assert [tuple(p) for p in r.locations] == sorted(w["locations"], key=lambda p: (ORDER.index(p[1]), p[2]))
        assert r.signature_hash == signature(w)
    assert {r.stable_usr: r.dropped_locations for r in ambiguous.collect()} == dropped
    manifests = spark.createDataFrame([(3, 1, 2), (4, 0, 5)], "diagnostic_count long, error_count long, unidentified_count long")
    assert tuple(symbols.unit_counts(manifests, ambiguous).first()) == (7, 1, 7 + sum(dropped.values()))


def test_signatures_tell_kinds_and_names_apart(spark):
    two = [(0, 0, "v", "N::x", "x", "x", "class", None, "a", "", [("definition", "f", 1)], None), (0, 1, "w", "N::y", "y", "x", "field", None, "", "a", [("definition", "f", 1)], None)]
    rows = symbols.merge_symbols(spark.createDataFrame(two, RECORD))[0].collect()
    assert len({r.signature_hash for r in rows}) == 2


def test_the_smaller_of_two_longest_notes_stays(spark):
    rows = [(u, 0, "v", "q", "n", "d", "k", None, "", "", [("definition", "f", 1)], note) for u, note in enumerate(["xyz", "abc", "ABD", "\U0001f600"])]
    got = symbols.merge_symbols(spark.createDataFrame(rows, RECORD), "unit")[0].first()
    assert got.documentation == "abc"  # of three UTF-16 units, as the others but the last, which has two


def test_nothing_to_merge(spark):
    none = spark.createDataFrame([], RECORD)
    for batch in (None, "unit"):
        got, bad = symbols.merge_symbols(none, batch)
        assert got.count() == 0 and bad.count() == 0
    assert tuple(symbols.unit_counts(spark.createDataFrame([], "diagnostic_count long, error_count long, unidentified_count long"), bad).first()) == (0, 0, 0)
    assert "unit" not in symbols.merge_symbols(none.withColumn("extra", F.lit(1)), "unit")[0].columns


def test_units_merge_in_two_shuffles_without_files(spark, monkeypatch):
    from pyspark.sql import DataFrameWriter

    monkeypatch.setattr(DataFrameWriter, "parquet", lambda *a, **k: 1 / 0)
    rows = [(u, 0, "v", "q", "n", "d", "k", None, "", "", [("definition", "f", 1)], None) for u in range(3)]
    for df in symbols.merge_symbols(spark.createDataFrame(rows, RECORD), "unit"):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 2 and "Expand" not in plan and "Join" not in plan


def test_counts_of_units_read_the_records_once(spark):
    rows = [(0, 0, "v", "q", "n", "d", "k", None, "", "", [("definition", "f", 1), ("definition", "g", 1)], None), (1, 0, "v", "q", "n", "d", "other", None, "", "", [("definition", "f", 1)], None)]
    ambiguous = symbols.merge_symbols(spark.createDataFrame(rows, RECORD), "unit")[1]
    counts = symbols.unit_counts(spark.createDataFrame([(1, 1, 1)], "diagnostic_count long, error_count long, unidentified_count long"), ambiguous)
    assert tuple(counts.first()) == (1, 1, 4)
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("stable_usr") and counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_what_a_conflicting_unit_says_is_not_merged(spark):
    row = lambda unit, at, kind, type, place, note: (unit, at, "v", "q", "n", "d", kind, None, type, "", [("definition", place, 1)], note)
    rows = [row(0, 0, "k", "T", "a", "short"), row(1, 0, "k", "", "b", "a longer note"), row(1, 1, "other", "S", "c", None), row(2, 0, "k", "", "a", None), row(2, 1, "k", "", "B", None)]
    got, bad = symbols.merge_symbols(spark.createDataFrame(rows, RECORD), "unit")
    one = got.first()
    assert (one.kind, one.type_spelling, one.documentation, [p.file for p in one.locations]) == ("k", "T", "short", ["a", "B"])
    assert [tuple(r) for r in bad.collect()] == [("v", 2)]
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def _below_first_shuffle(df):
    """The part of a plan that reads the records and deals them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.rindex("Exchange hashpartitioning") :]


def test_counts_of_units_aggregate_nothing_before_the_records_are_shuffled(spark):
    rows = [(u, 0, "v", "q", "n", "d", "k", None, "", "", [("definition", "f", u % 2), ("definition", "f", u % 2)], None) for u in range(3)]
    ambiguous = symbols.merge_symbols(spark.createDataFrame(rows, RECORD), "unit", "at")[1]
    counts = symbols.unit_counts(spark.createDataFrame([(1, 1, 1)], "diagnostic_count long, error_count long, unidentified_count long"), ambiguous)
    below = _below_first_shuffle(counts)
    assert "stable_usr" in below and "Aggregate" not in below and "Generate" not in below
    assert tuple(counts.first()) == (1, 1, 1)


def test_a_merge_aggregates_nothing_before_the_records_are_shuffled(spark):
    rows = [(u, 0, "v", "q", "n", "d", "k", None, "", "", [("definition", "f", u % 2), ("definition", "f", u % 2)], None) for u in range(3)]
    df = spark.createDataFrame(rows, RECORD)
    for batch in (None, "unit"):
        got = symbols.merge_symbols(df, batch)[0]
        below = _below_first_shuffle(got)
        assert "stable_usr" in below and "Aggregate" not in below and "Generate" not in below
        assert [p.start_line for p in got.first().locations] == [0, 1]
