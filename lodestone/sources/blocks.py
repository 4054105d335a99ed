"""Documentation records: indented text as rows of leaves by a table function, and the symbols that these describe.

``leaves`` turns one text into a row for each scalar, with the path of keys that leads to it and the numbers of the list
items on the way. All that records mean is found on these rows by grouping them.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import stash
from lodestone.validate import require

#: Limits of a record, and the forms of its scalars.
MOST_BYTES, MOST_LINES, DEEPEST, LONGEST = 16 << 20, 500_000, 32, 4096
_KEY = re.compile(r"([A-Za-z][A-Za-z0-9]*)\s*:(?:\s+(.*)|)$")
_SCALAR = re.compile(r"(?P<single>'.*')|(?P<double>\".*\")|(?P<open>['\"&*!>|@`{}\[\]].*)|(?P<number>-?(?:0|[1-9][0-9]*))|(?P<flag>true|false)|(?P<none>null)|(?P<text>.+)", re.S)
ID = "^[A-F0-9]{40}$"
KINDS = {"Class": "class", "Struct": "struct", "Union": "union"}


class RecordError(ValueError):
    """The text is not a documentation record."""


def _scalar(text: str) -> tuple[str | None, str]:
    """(value, kind) of an encoded scalar: text, number, flag or none."""
    m = _SCALAR.fullmatch(text)
    kind = m.lastgroup if m else "open"
    if kind == "double":
        try:
            return json.loads(text), "text"
        except ValueError:
            kind = "open"
    if kind == "open":
        raise RecordError(f"a scalar that isn't supported: {text[:20]}")
    if kind == "single":
        return text[1:-1].replace("''", "'"), "text"
    return (None if kind == "none" else text), kind


def _lines(text: str):
    if text is None or "\0" in text or "\t" in text or len(text.encode("utf-8", "surrogatepass")) > MOST_BYTES:
        raise RecordError("text out of bounds")
    lines = re.split("\r\n|\r|\n", text)
    if len(lines) > MOST_LINES:
        raise RecordError("too many lines")
    for n, line in enumerate(lines, 1):
        body = line.lstrip(" ")
        if body.strip() and body.strip() not in ("---", "..."):
            yield n, len(line) - len(body), body.strip()


@F.udtf(returnType="path string, place array<int>, value string, kind string, line int")
class Leaves:
    """One row for each scalar of an indented text. Open mappings and lists stand on a stack by their indentation."""

    def eval(self, text: str):
        stack, waits = [], None  # open nodes: [indent, is a list, path, place, keys or number of items]; a key or item without a value yet
        for line, indent, body in _lines(text):
            item = body.startswith("-")
            if not stack:
                if indent:
                    raise RecordError(f"line {line}: it begins indented")
                stack.append([0, item, "", [], set() if not item else 0])
            elif waits and indent > waits[0]:
                stack.append([indent, item, waits[1], waits[2], set() if not item else 0])
            elif waits and waits[3]:
                raise RecordError(f"line {line}: an item without a value")
            elif waits:
                yield waits[1], waits[2], None, "none", line
            waits = None
            while stack and stack[-1][0] > indent:
                stack.pop()
            if indent % 2 or not stack or stack[-1][0] != indent or stack[-1][1] != item or len(stack) > DEEPEST:
                raise RecordError(f"line {line}: indentation")
            _, _, path, place, seen = stack[-1]
            first = False
            if item:
                body, place = body[1:].strip(), [*place, seen]
                stack[-1][4] += 1
                if not body:
                    waits = (indent, path, place, True)
                    continue
                if ":" not in body:
                    yield path, place, *_scalar(body), line
                    continue
                indent, first, seen = indent + 2, True, set()
                stack.append([indent, False, path, place, seen])
            pair = _KEY.match(body)
            if not pair or pair[1] in seen:
                raise RecordError(f"line {line}: no key, or a key that came before")
            seen.add(pair[1])
            path = f"{path}/{pair[1]}".lstrip("/")
            if pair[2] and pair[2].strip():
                yield path, place, *_scalar(pair[2].strip()), line
            else:
                waits = (indent, path, place, first)
        if not stack or (waits and waits[3]):
            raise RecordError("it ends too early")
        if waits:
            yield waits[1], waits[2], None, "none", line


def leaves(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(file, path, place, value, kind, line) of the scalars of all ``files``; a malformed text raises."""
    rows = files.select(F.col(path).alias("file"), F.col(text).alias("_text"))
    return rows.lateralJoin(Leaves(F.col("_text").outer())).drop("_text")


_LISTS = ("Params", "Location", "Members")
_TEXTS = ("Name", "USR", "QualName", "Filename", "Contents", "Access")


def _first(*paths: str) -> Column:
    """The value at the first of some paths that has one."""
    own = lambda p: F.filter("leaves", lambda x: x["path"] == p)
    return F.coalesce(*[F.array_max(F.transform(own(p), lambda x: x["value"])) for p in paths])


def _list(which) -> Column:
    """The values of the leaves where ``which`` holds, in the order of their items."""
    told = F.transform(F.filter("leaves", which), lambda x: F.struct(x["place"].alias("place"), x["value"].alias("value")))
    return F.transform(F.array_sort(told), lambda x: x["value"])


def _items(key: str, *fields: str) -> Column:
    """The items of the list ``key``, which are mappings, in their order."""
    own = F.filter("items", lambda i: i["list"] == key)
    return F.transform(F.array_sort(own), lambda i: F.struct(*[i[c].alias(c) for c in fields])).alias(key)


def documented_symbols(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """A row for each record's symbol (item -1) and for each of its functions (item from 0).

    (file, item, documentation_id, stable_usr, name, qualified_name, kind, owner_usr, signature, signature_hash, documentation,
    template_parameters, locations: kind, file, line; members: name, type, access). Malformed records raise.

    The leaves are shuffled once, by file: those of a list's item are grouped first, then all of a record or function.
    """
    all_leaves = leaves(files, path, text).repartition("file")
    function = F.col("path").startswith("ChildFunctions/")
    own = all_leaves.withColumn("item", F.when(function, F.col("place")[0]).otherwise(-1)).withColumns({
        "path": F.when(function, F.substring("path", len("ChildFunctions/") + 1, 1 << 20)).otherwise(F.col("path")),
        "place": F.when(function, F.slice("place", 2, DEEPEST)).otherwise(F.col("place")),
    })
    own = own.where((F.col("item") >= 0) | (F.col("path") != "ChildFunctions"))
    last = F.element_at(F.split("path", "/"), -1)
    is_text = (F.col("kind") == "text") & F.length("value").between(1, LONGEST) & ~F.col("value").contains("\n")
    inside = ~F.col("path").startswith("Description") & (F.col("kind") != "none")
    leaf_rules = {
        "text fields": ~last.isin(*_TEXTS) | is_text, "symbol ids": (last != "USR") | F.col("value").rlike(ID),
        "lines": (last != "LineNumber") | ((F.col("kind") == "number") & F.coalesce(F.expr("try_cast(value AS bigint)") >= 1, F.lit(False))),
    }
    said = lambda x: x["path"].rlike("^Description(/Children)*/Text$") & (x["kind"] == "text")
    at_path = lambda p: lambda x: x["path"] == p
    key = F.coalesce(*[F.when(F.col("path").startswith(f"{k}/"), k) for k in _LISTS], F.lit(""))
    bad = {f"bad_{i}": (inside & ~F.coalesce(good, F.lit(False))).cast("long") for i, good in enumerate(leaf_rules.values())}
    grouped = own.withColumns({"list": key, **bad}).groupBy("file", "item", "list", F.when(F.col("list") != "", F.col("place")).alias("at"))
    parts = grouped.agg(F.collect_list(F.struct("path", "place", "value", "kind")).alias("leaves"), *[F.sum(c).alias(c) for c in bad])
    whole = F.struct(
        _first("USR").alias("documentation_id"), _first("Name").alias("name"), _first("TagType").alias("tag"), _first("IsMethod").alias("method"),
        _first("Parent/USR").alias("parent"), _first("Parent/QualName", "Parent/Name").alias("parent_name"), F.reverse(_list(at_path("Namespace/Name"))).alias("owners"),
        _first("ReturnType/Type/QualName", "ReturnType/Type/Name").alias("returns"), _list(at_path("Template/Params/Contents")).alias("template_parameters"),
        _first("DefLocation/Filename").alias("file_defined"), _first("DefLocation/LineNumber").cast("long").alias("line_defined"),
        F.array_join(F.filter(F.transform(_list(said), lambda t: F.trim(t)), lambda t: t != ""), "\n").alias("documentation"),
    )
    item = F.struct(
        "list", "at", _first("Members/Name").alias("name"), _first("Params/Type/QualName", "Members/Type/QualName", "Params/Type/Name", "Members/Type/Name").alias("type"), F.lower(_first("Members/Access")).alias("access"),
        _first("Location/Filename").alias("file"), _first("Location/LineNumber").cast("long").alias("line"),
    )
    parts = parts.select("file", "item", F.when(F.col("list") == "", whole).alias("whole"), F.when(F.col("list") != "", item).alias("of"), *bad)
    joined = parts.groupBy("file", "item").agg(F.max("whole").alias("whole"), F.collect_list("of").alias("items"), *[F.sum(c).alias(c) for c in bad])
    joined = joined.select("file", "item", "whole.*", _items("Params", "type"), _items("Location", "file", "line"), _items("Members", "name", "type", "access"), *bad)
    empty = F.array().cast("array<string>")
    joined = joined.withColumns({"owners": F.coalesce("owners", empty), "template_parameters": F.coalesce("template_parameters", empty), "documentation": F.coalesce("documentation", F.lit(""))})
    root, known = F.col("item") < 0, F.col("Members")
    joined = joined.withColumn("root_name", F.max(F.when(root, F.col("name"))).over(Window.partitionBy("file")))
    rules = {rule: F.col(c) == 0 for rule, c in zip(leaf_rules, bad)}
    rules |= {"symbol id and name": F.col("documentation_id").isNotNull() & F.col("name").isNotNull(), "members with a type": F.forall(known, lambda m: m["name"].isNotNull() & m["type"].isNotNull())}
    rules |= {"parameters with a type": F.forall("Params", lambda p: p["type"].isNotNull())}
    joined = require(stash(joined, "records"), rules)
    usr = lambda c: F.concat(F.lit("clang-doc-sha1:"), F.lower(c))
    path_name = F.array_join(F.concat("owners", F.array("name")), "::")
    qualified = F.when(~root & F.col("parent").isNotNull(), F.concat_ws("::", "parent_name", "name")).otherwise(path_name)
    tag = F.coalesce(*[F.when(F.col("tag") == t, k) for t, k in KINDS.items()], F.lit("namespace"))
    of_function = F.when(F.col("name") == F.col("root_name"), "constructor").when(F.col("name") == F.concat(F.lit("~"), "root_name"), "destructor").when(F.col("method") == "true", "method").otherwise("function")
    template = F.when(F.size("template_parameters") > 0, F.concat(F.lit("<"), F.array_join("template_parameters", ","), F.lit(">"))).otherwise("")
    types = F.array_join(F.transform("Params", lambda p: p["type"]), ",")
    call = F.concat(F.coalesce(F.concat("returns", F.lit(" ")), F.lit("")), "qualified_name", F.lit("("), F.coalesce(types, F.lit("")), F.lit(")"))
    place = lambda kind, file, line: F.struct(F.lit(kind).alias("kind"), file.alias("file"), line.alias("line"))
    defined = F.when(F.col("file_defined").isNotNull(), F.array(place("definition", F.col("file_defined"), F.col("line_defined")))).otherwise(F.array().cast("array<struct<kind:string,file:string,line:bigint>>"))
    declared = F.transform("Location", lambda x: place("declaration", x["file"], x["line"]))
    out = joined.where("root_name is not null").withColumns({"qualified_name": qualified, "kind": F.when(root, tag).otherwise(of_function)})
    out = out.withColumn("signature", F.when(root, F.concat("kind", F.lit(" "), "qualified_name", template)).otherwise(call))
    return out.select(
        "file", "item", "documentation_id", usr("documentation_id").alias("stable_usr"), "name", "qualified_name", "kind", usr("parent").alias("owner_usr"), "signature", F.sha2("signature", 256).alias("signature_hash"),
        F.nullif("documentation", F.lit("")).alias("documentation"), "template_parameters", F.when(root, defined).otherwise(F.concat(declared, defined)).alias("locations"), known.alias("members"),
    )


def documentation_records(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """What ``symbols.attach_documentation`` takes: (documentation_id, name, text, qualified_name, kind, template_parameters)."""
    return documented_symbols(files, path, text).select("documentation_id", "name", F.col("documentation").alias("text"), "qualified_name", "kind", "template_parameters")
