"""Scans of build files and headers, as expressions over a text column: module rules, descriptors, annotations, commands."""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.chunks import path_key
from lodestone.sources.blocks import documentation_records, documented_symbols
from lodestone.sources.lexing import annotation_diagnostics, annotations, module_diagnostics, module_rules
from lodestone.storage import stash
from lodestone.validate import ValidationError, require

_STRING = r"@\"(?:[^\"]|\"\")*\"|\"(?:\\.|[^\"\\])*\""

_STRINGS = T.ArrayType(T.StringType())
__all__ = [
    "annotation_diagnostics", "annotations", "command_arguments", "compile_commands", "corpus_audit", "descriptors", "documentation_records", "documented_symbols", "expand_responses", "lenient_json", "module_diagnostics",
    "module_rules", "target_rules", "walk", "without_comments",
]


def without_comments(code: Column) -> Column:
    """``code`` with comments blanked; strings stay, and so do line numbers."""
    strings_or_comments = f"({_STRING}|'(?:\\\\.|[^'\\\\])*')|//[^\\n]*|/\\*[^*]*\\*+(?:[^/*][^*]*\\*+)*/"
    return _blank_lines(code, strings_or_comments)


def _blank_lines(code: Column, pattern: str) -> Column:
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        found = re.compile(pattern)
        keep = lambda m: m[0] if m[1] is not None else re.sub(r"[^\n]", " ", m[0])
        return texts.map(lambda t: None if t is None else found.sub(keep, t.replace("\r\n", "\n")))

    return run(code)


def target_rules(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, target, target_type, modules) of target rules files."""
    code = files.select(path, without_comments(F.col(text)).alias("code"))
    extra = F.flatten(F.transform(F.regexp_extract_all("code", F.lit(r"ExtraModuleNames\s*\.\s*(?:Add|AddRange)\s*\(([^)]*)\)"), F.lit(1)), lambda a: F.regexp_extract_all(a, F.lit('"([^"]+)"'), F.lit(1))))
    return code.select(path, F.regexp_extract("code", r"\bclass\s+([A-Za-z][A-Za-z0-9_]*)\s*:\s*TargetRules\b", 1).alias("target"), F.regexp_extract("code", r"\bType\s*=\s*TargetType\.([A-Za-z]+)", 1).alias("target_type"), extra.alias("modules"))


def lenient_json(text: Column) -> Column:
    """JSON with a byte-order mark, comments and trailing commas, as strict JSON."""
    plain = _blank_lines(F.regexp_replace(text, "^\\uFEFF", ""), r"(\"(?:\\.|[^\"\\])*\")|//[^\n]*|/\*.*?\*/")
    return F.regexp_replace(plain, ",(\\s*[}\\]])", "$1")


DESCRIPTOR = "FileVersion int, Modules array<struct<Name:string,Type:string,LoadingPhase:string,WhitelistPlatforms:array<string>,PlatformAllowList:array<string>>>, Plugins array<struct<Name:string,Enabled:boolean>>"


def descriptors(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, modules, plugins) of project and plugin descriptors; the older name of a platform list counts as well."""
    d = files.select(path, F.from_json(lenient_json(F.col(text)), DESCRIPTOR).alias("d"))
    module = lambda m: F.struct(m["Name"].alias("name"), m["Type"].alias("type"), m["LoadingPhase"].alias("phase"), F.coalesce(m["PlatformAllowList"], m["WhitelistPlatforms"]).alias("platforms"))
    return d.select(path, F.transform("d.Modules", module).alias("modules"), F.transform("d.Plugins", lambda p: F.struct(p["Name"].alias("name"), F.coalesce(p["Enabled"], F.lit(False)).alias("enabled"))).alias("plugins"))


@F.pandas_udf(_STRINGS)
def command_arguments(lines: pd.Series) -> pd.Series:
    """Arguments of Windows command lines: quotes group, 2n backslashes before a quote are n, one more makes it literal."""
    unit = re.compile(r'(\\*)"|(\\+)|([^\s"\\]+)|(\s+)')

    def one(line):
        out, now, quoted, open_ = [], [], False, False
        for slashes, plain, text, space in ((m[1], m[2], m[3], m[4]) for m in unit.finditer(line or "")):
            if slashes is not None:
                now.append("\\" * (len(slashes) // 2) + ('"' if len(slashes) % 2 else ""))
                quoted, open_ = quoted ^ (len(slashes) % 2 == 0), True
            elif space is not None and not quoted:
                if open_:
                    out.append("".join(now))
                now, open_ = [], False
            else:
                now.append(plain or text or space)
                open_ = True
        if quoted:
            raise ValueError("a quote isn't closed")
        return [*out, "".join(now)] if open_ else out

    return lines.map(one)


#: Most levels of response files within each other, bytes of one, arguments of a command; files, and bytes of all that are used.
NESTED, RESPONSE_BYTES, ARGUMENTS = 5, 16 << 20, 16_384
RESPONSE_FILES, ALL_BYTES = 50_000, 192 << 20


def expand_responses(commands: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """``commands`` (id, directory, command or arguments) with ``arguments`` whose ``@file`` are replaced by what the files hold.

    ``files`` has (path, text). Paths are taken from the command's directory and must lie below one of ``roots``; a file that
    is missing or too long, too deep a nesting, too many arguments, and too many files or bytes of them raise. A level of
    nesting is one join.
    """
    given = F.coalesce("arguments", command_arguments("command")) if "arguments" in commands.columns else command_arguments("command")
    now = commands.select("id", "directory", F.posexplode(given).alias("i", "arg")).select("id", "directory", F.array("i").alias("place"), "arg")
    flat = F.regexp_replace("text", "[\\r\\n]+", " ")
    known = files.select(path_key(F.col("path")).alias("_path"), command_arguments(flat).alias("_args"), (F.octet_length("text") <= RESPONSE_BYTES).alias("_short"), F.octet_length("text").cast("long").alias("_bytes"))
    done, left, used = None, now, None
    for _ in range(NESTED + 1):
        plain, named = left.where("not startswith(arg, '@')"), stash(left.where("startswith(arg, '@')"), "responses")
        done = plain if done is None else done.unionByName(plain)
        if named.isEmpty():
            break
        name = F.regexp_replace(F.substring("arg", 2, 1 << 16), '^"|"$', "")
        whole = path_key(F.when(name.startswith("/"), name).otherwise(F.concat_ws("/", "directory", name)))
        inside = reduce(or_, [whole.startswith(r.rstrip("/") + "/") for r in roots])
        require(named, {"response file below a root": (F.length(name) > 0) & inside})
        joined = stash(named.withColumn("_at", whole).join(known, F.col("_at") == F.col("_path"), "left"), "expanded")
        require(joined, {"response file that is there": F.col("_path").isNotNull() & F.col("_short")})
        own = joined.select("_path", "_bytes").distinct()
        used = own if used is None else used.unionByName(own).distinct()
        require(used.agg(F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("bytes")), {"number of response files": F.col("n") <= RESPONSE_FILES, "bytes of response files": F.col("bytes") <= ALL_BYTES})
        left = joined.select("id", "directory", "place", F.posexplode("_args").alias("i", "arg")).select("id", "directory", F.concat("place", F.array("i")).alias("place"), "arg")
    else:
        raise ValidationError("response files are nested too deep")
    args = F.transform(F.array_sort(F.collect_list(F.struct("place", "arg"))), lambda x: x["arg"])
    out = commands.drop("arguments").join(done.groupBy("id").agg(args.alias("arguments")), "id", "left").withColumn("arguments", F.coalesce("arguments", F.array().cast("array<string>")))
    return require(out, {"number of arguments": F.size("arguments") <= ARGUMENTS})


def compile_commands(commands: DataFrame, files: DataFrame | None = None, roots: list[str] | None = None) -> DataFrame:
    """Normalised compile commands (directory, file, command or arguments): include paths, forced includes, definitions, hash.

    With ``files`` (path, text) and ``roots``, commands (with an id) have their response files expanded first.
    """
    if files is not None:
        commands = expand_responses(commands, files, roots or [])
    args = F.coalesce("arguments", command_arguments("command"))
    rows = commands.withColumn("args", args)
    after = lambda flag: F.transform(F.filter("args", lambda a: a.startswith(flag) & (F.length(a) > len(flag))), lambda a: F.substring(a, F.lit(len(flag) + 1), F.length(a)))
    return rows.select("directory", F.translate("file", "\\", "/").alias("file"), F.concat(after("-I"), after("/I")).alias("include_paths"), after("/FI").alias("forced_includes"), F.concat(after("-D"), after("/D")).alias("definitions"), F.sha2(F.to_json(F.struct("directory", "file", "args")), 256).alias("content_hash"))


#: The build files of a corpus, by the end of their name.
FILE_KINDS = {".Build.cs": "module", ".Target.cs": "target", ".uproject": "project", ".uplugin": "plugin"}


def walk(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, kind, text) of the build files below ``roots``."""
    kind = F.coalesce(*[F.when(F.col("path").endswith(end), F.lit(k)) for end, k in FILE_KINDS.items()])
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{cs,uproject,uplugin}").load(list(roots))
    return found.withColumn("kind", kind).where("kind is not null").select("path", "kind", F.decode("content", "UTF-8").alias("text"))


def corpus_audit(files: DataFrame) -> DataFrame:
    """(kind, parsed, n): how many of the walked files the scans understand."""
    broken = module_diagnostics(files.where("kind = 'module'")).where("not readable").select("path").distinct().withColumn("broken", F.lit(True))
    target = F.col("text").rlike("\\bclass\\s+[A-Za-z][A-Za-z0-9_]*\\s*:\\s*TargetRules\\b")
    strict = F.try_parse_json(lenient_json(F.col("text"))).isNotNull()
    parsed = F.when(F.col("kind") == "module", F.col("broken").isNull()).when(F.col("kind") == "target", target).otherwise(strict)
    return files.join(broken, "path", "left").withColumn("parsed", parsed).groupBy("kind", "parsed").agg(F.count(F.lit(1)).alias("n"))
