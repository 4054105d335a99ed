"""Merging of extracted symbols across translation units, and what documentation and annotations add to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import last_segment
from lodestone.validate import require, require_unique

#: Fields that must agree for one identity; those that may be empty in some records.
IDENTITY, FILLED = ("qualified_name", "name", "display_name", "kind", "owner_usr"), ("type_spelling", "result_type")


def ambiguous_keys(records: DataFrame, key: str, *identity: str) -> DataFrame:
    """Keys that records describe in more than one way; null is a value."""
    parts = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0none")) for c in identity])
    return records.groupBy(key).agg(F.count_distinct(parts).alias("n_identities")).where("n_identities > 1")


#: Order of names and texts for people, as the store has it: the root locale's.
LOCALE = "UNICODE"


def _in_locale(c: Column) -> Column:
    return F.collate(c.cast("string"), LOCALE)


def utf16_length(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16LE")) / 2


def signature_hash() -> Column:
    """SHA-256 of the canonical JSON of what makes a signature."""
    return F.sha2(F.to_json(F.struct("kind", "qualified_name", "display_name", "type_spelling", "result_type"), {"ignoreNullFields": "false"}), 256)


def _several(c: Column) -> Column:
    """More than one value of a column, of which null is none."""
    return F.coalesce(F.min(c) != F.max(c), F.lit(False))


def _longest(order: str | None, ties: Column | None) -> Column:
    """The longest documentation with its rank: of several longest ones ``ties`` decides, then the first by ``order``."""
    rank = [(-utf16_length(F.col("documentation"))).alias("length"), *([] if ties is None else [ties.alias("ties")]), *([F.col(order).alias("by")] if order else [])]
    return F.min(F.when(F.col("documentation").isNotNull(), F.struct(*rank, F.col("documentation").alias("text"))))


def _told(records: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row for the records of one identity in one unit, in one shuffle: ``conflict``, ``dropped_locations``, and the fields and
    distinct locations as they are where the records agree.

    Records conflict if they have more than one value of an identity field (null is a value), or more than one non-empty
    value of a filled one. Records are shuffled as they are and told together behind it, where a task is as large as a
    shuffle's partition; before it, a task is as large as a split of a file, whose records share few keys and outgrow memory.
    """
    more = [order] if order and order not in keys else []
    dealt = records.select(*keys, *IDENTITY, *FILLED, "documentation", *more, "locations").repartition(*keys)
    rows = dealt.select(*keys, F.struct(*IDENTITY).alias("identity"), *FILLED, "documentation", *more, F.explode_outer("locations").alias("_at"))
    said = _longest(order, None if order else _in_locale(F.col("documentation")))["text"]
    conflict = reduce(Column.__or__, [_several(F.col("identity")), *[_several(F.nullif(F.col(c), F.lit(""))) for c in FILLED]])
    out = rows.groupBy(*keys).agg(
        conflict.alias("conflict"), F.count("_at").alias("dropped_locations"), F.min("identity").alias("identity"), *[F.max(c).alias(c) for c in FILLED], said.alias("documentation"), F.collect_set("_at").alias("locations")
    )
    return out.select(*keys, "conflict", "dropped_locations", "identity.*", *FILLED, "documentation", "locations")


def _in_order(at: Column, fields: list[str]) -> Column:
    """An array of locations in order; equal ones stand together."""
    rank = [x for x in ("file", "start_line", "start_column", "end_line", "end_column", "kind") if x in fields]
    text = lambda c: c if c not in ("file", "kind") else f"_{c}"
    ranked = F.transform(at, lambda x: F.struct(*[(_in_locale(x[c]) if text(c) != c else x[c]).alias(text(c)) for c in rank], x.alias("at")))
    return F.transform(F.array_sort(ranked), lambda x: x["at"])


def _fields(locations: DataFrame) -> list[str]:
    return [f.name for f in locations.schema["locations"].dataType.elementType]


def _distinct(column: str) -> Column:
    """A sorted array without repeated values."""
    return F.filter(column, lambda x, i: (i == 0) | (x != F.get(F.col(column), i - 1)))


def merge_unit(records: DataFrame, keys: list[str], order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(symbols, ambiguous) of the records of single units, a record having one location or more.

    An identity that records conflict about is dropped with all its records, whatever their order, and counted in
    ``ambiguous``. Of two longest documentations the first by ``order`` stays (without one: the smaller in locale order).
    """
    told = _told(records, keys, order)
    good = told.where("not conflict").drop("conflict", "dropped_locations").withColumn("locations", _in_order(F.col("locations"), _fields(told)))
    return good.withColumn("signature_hash", signature_hash()), told.where("conflict").select(*keys, "dropped_locations")


def _merged(told: DataFrame, unit: str) -> DataFrame:
    """One row for each identity of ``told``, a row for each of its units: what the units agree on, and what was dropped.

    A unit conflicts from the first one on that has another value than the first unit to have one. Units that conflict in
    themselves count as dropped and for nothing else.
    """
    by = Window.partitionBy("stable_usr").orderBy(unit)
    good, now = ~F.col("conflict"), by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = [F.when(good, F.struct(*IDENTITY)), *[F.when(good, F.nullif(F.col(c), F.lit(""))) for c in FILLED]]
    named = told.withColumns({f"_v{i}": v for i, v in enumerate(values)} | {"documentation": F.when(good, F.col("documentation"))})
    other = [F.coalesce(F.col(f"_v{i}") != F.first(f"_v{i}", ignorenulls=True).over(now), F.lit(False)) for i in range(len(values))]
    rows = named.withColumn("_other", reduce(Column.__or__, other)).withColumn("_late", F.max("_other").over(now)).withColumn("_early", good & ~F.col("_late"))
    out = rows.groupBy("stable_usr").agg(
        F.max("_late").alias("late"), F.count_if(good).alias("units"), F.min("_v0").alias("identity"), *[F.max(F.when(good, F.col(c))).alias(c) for c in FILLED],
        _longest(unit, _in_locale(F.col("documentation")))["text"].alias("documentation"), F.flatten(F.collect_list(F.when(F.col("_early"), F.col("locations")))).alias("locations"),
        F.count_if("conflict").alias("lost_units"), F.sum(F.when(F.col("conflict"), F.col("dropped_locations"))).alias("lost"), F.sum(F.when(good & F.col("_late"), F.size("locations"))).alias("later"),
    )
    out = out.withColumn("locations", _in_order(F.col("locations"), _fields(told))).withColumn("locations", _distinct("locations"))
    return out.select("stable_usr", "late", "units", "identity.*", *FILLED, "documentation", "locations", "lost_units", "lost", "later")


def _results(merged: DataFrame) -> tuple[DataFrame, DataFrame]:
    symbols = merged.where("units > 0 and not late").select("stable_usr", *IDENTITY, *FILLED, "documentation", "locations")
    none = F.lit(0).cast("long")
    late = F.when(F.col("late"), F.coalesce("later", none) + F.size("locations")).otherwise(none)
    bad = merged.where("late or lost_units > 0").select("stable_usr", (F.coalesce("lost", none) + late).alias("dropped_locations"))
    return symbols.withColumn("signature_hash", signature_hash()), bad


def merge_units(units: DataFrame, unit: str = "unit") -> tuple[DataFrame, DataFrame]:
    """(symbols, ambiguous) of the symbols of several units, each identity at most once a unit, merged in the order of ``unit``.

    Fields that are empty in some units are filled, locations are the distinct ones in order, and the longest documentation
    stays, of several the smallest in locale order. From the first unit that conflicts with those before it an identity is
    ambiguous: ``dropped_locations`` counts the distinct locations merged until then and all that come with it or later.
    """
    return _results(_merged(units.withColumns({"conflict": F.lit(False), "dropped_locations": F.lit(0).cast("long")}), unit))


def merge_symbols(records: DataFrame, batch: str | None = None, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(symbols, ambiguous: stable_usr, dropped_locations): records of one unit, or of several named by ``batch``.

    Several are merged within each first, so that a unit that agrees brings an identity back that another has dropped: one
    shuffle of the records, one of the units' symbols. Nothing is stored, so each of the two results works for itself.
    """
    if not batch:
        return merge_unit(records, ["stable_usr"], order)
    return _results(_merged(_told(records, [batch, "stable_usr"], order), batch))


def unit_counts(manifests: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """One row: the sums of the units' own counts (diagnostic_count, error_count, unidentified_count), the latter with what merging dropped."""
    dropped = ambiguous.agg(F.coalesce(F.sum("dropped_locations"), F.lit(0)).alias("dropped"))
    sums = manifests.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("diagnostic_count", "error_count", "unidentified_count")])
    return sums.crossJoin(dropped).select("diagnostic_count", "error_count", (F.col("unidentified_count") + F.col("dropped")).alias("unidentified_count"))


def _documented(symbols: DataFrame, docs: DataFrame) -> tuple[DataFrame, dict]:
    """Symbols joined with their records, and the fields that these have."""
    own = {c: f"_{c}" for c in ("qualified_name", "kind", "template_parameters") if c in docs.columns}
    there = docs.select(F.upper("documentation_id").alias("_id"), F.col("text").alias("_text"), *[F.col(c).alias(a) for c, a in own.items()])
    return symbols.join(there, F.upper(F.sha1(F.col("stable_usr").cast("binary"))) == F.col("_id"), "left"), own


def attach_documentation(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """Documentation records (documentation_id: SHA-1 of the identity, text, and if known qualified_name, kind,
    template_parameters) joined; the longer text stays. A record of another name or kind than its symbol's raises, as do
    two of one identity."""
    require_unique(docs.select(F.upper("documentation_id").alias("documentation_id")), "documentation_id")
    joined, own = _documented(symbols, docs)
    require(joined, {f"{c} of the documentation": F.col("_id").isNull() | F.col(c).eqNullSafe(F.col(own[c])) for c in ("qualified_name", "kind") if c in own} or {"identity": F.lit(True)})
    longer = F.when(F.length("_text") > F.coalesce(F.length("documentation"), F.lit(0)), F.col("_text")).otherwise(F.col("documentation"))
    out = joined.withColumn("documentation", longer).withColumnRenamed("_id", "documentation_id")
    if "template_parameters" in own:
        out = out.withColumn("template_parameters", F.coalesce("_template_parameters", F.array().cast("array<string>")))
    return out.drop("_text", *own.values())


def unmatched_documentation(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """The ids of the records that belong to no symbol, in order."""
    known = symbols.select(F.upper(F.sha1(F.col("stable_usr").cast("binary"))).alias("documentation_id"))
    return docs.select(F.upper("documentation_id").alias("documentation_id")).join(known, "documentation_id", "left_anti").orderBy("documentation_id")


#: For each macro the kinds of exposure, first match first, and the specifiers that give them.
EXPOSURE = [
    ("UCLASS", "type", ("BlueprintType", "Blueprintable")), ("UPROPERTY", "property", ("BlueprintReadOnly", "BlueprintReadWrite")), ("UFUNCTION", "pure", ("BlueprintPure",)),
    ("UFUNCTION", "event", ("BlueprintImplementableEvent", "BlueprintNativeEvent")), ("UFUNCTION", "callable", ("BlueprintCallable",)),
]


def exposure(macro: Column, specifiers: Column) -> Column:
    """How an annotation exposes its symbol: the first of ``EXPOSURE`` that fits, else none."""
    return F.coalesce(*[F.when((macro == m) & F.arrays_overlap(specifiers, F.array(*map(F.lit, names))), kind) for m, kind, names in EXPOSURE], F.lit("none"))


def annotated(symbols: DataFrame, attached: DataFrame) -> DataFrame:
    """``symbols`` with the specifiers and exposure of the annotation attached to each; two at one symbol raise."""
    own = attached.where("status = 'attached'").select("stable_usr", "specifiers", exposure(F.col("macro"), F.col("specifiers")).alias("exposure"))
    out = symbols.join(require_unique(own, "stable_usr"), "stable_usr", "left")
    return out.withColumns({"specifiers": F.coalesce("specifiers", F.array().cast("array<string>")), "exposure": F.coalesce("exposure", F.lit("none"))})


def attach_annotations(symbols: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotations (annotation_id, macro, symbol_name, declaration_line, ...) with status and the symbol they stand at.

    They join on name, line and class of kind; the file isn't compared, so a line and name of two files are ambiguous.
    """
    kinds = F.when(F.col("kind").isin("class", "struct"), "UCLASS").when(F.col("kind").isin("function", "method"), "UFUNCTION").when(F.col("kind") == "field", "UPROPERTY")
    lines = symbols.select("stable_usr", kinds.alias("macro"), last_segment(F.col("qualified_name")).alias("symbol_name"), F.explode("locations").alias("at"))
    lines = lines.where("at.kind in ('declaration', 'definition')").select("stable_usr", "macro", "symbol_name", F.col("at.start_line").alias("declaration_line")).distinct()
    found = annotations.select("annotation_id", "macro", "symbol_name", "declaration_line").join(lines, ["macro", "symbol_name", "declaration_line"])
    per = found.groupBy("annotation_id").agg(F.count(F.lit(1)).alias("n"), F.min("stable_usr").alias("stable_usr"))
    status = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "ambiguous").otherwise("attached")
    return annotations.join(per, "annotation_id", "left").withColumn("status", status).withColumn("stable_usr", F.when(F.col("n") == 1, F.col("stable_usr"))).drop("n")
