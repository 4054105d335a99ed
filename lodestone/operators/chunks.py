"""Code chunks: slices of sources at symbol locations, split under budgets, with content-addressed keys."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text as tx
from lodestone.storage import stash
from lodestone.validate import require_unique

MOST_BYTES, MOST_TOKENS = 16 * 1024, 2_000
_SPACE = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_PIECE = re.compile(f"[{_SPACE}]+|[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\\.[0-9]+)?|[^{_SPACE}\x00-\x7f]|[^{_SPACE}A-Za-z0-9_]")
_TRIM = "\t\n\x0b\x0c\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
_BLANK = frozenset(_TRIM)
COORDINATES = ["start_line", "start_column", "end_line", "end_column"]


@F.pandas_udf(T.StringType())
def source_slice(text: pd.Series, l1: pd.Series, c1: pd.Series, l2: pd.Series, c2: pd.Series) -> pd.Series:
    """The trimmed text between two places (from 1, end excluded, columns in UTF-16 units); null if they aren't in it."""

    def one(t, a, b, c, d):
        if t is None:
            return None
        lines = t.split("\n")
        ends = []
        for line, column in ((a, b), (c, d)):
            if not 1 <= line <= len(lines) or column < 1:
                return None
            units = lines[line - 1].encode("utf-16-le", "surrogatepass")
            if 2 * (column - 1) > len(units):
                return None
            ends.append((line, column))
        if ends[1] <= ends[0]:
            return None
        cut = lines[a - 1 : c]
        last = cut[-1].encode("utf-16-le", "surrogatepass")[: 2 * (d - 1)]
        cut[-1] = last.decode("utf-16-le", "replace")
        first = cut[0].encode("utf-16-le", "surrogatepass")[2 * (b - 1) :]
        cut[0] = first.decode("utf-16-le", "replace")
        return "\n".join(cut).strip(_TRIM)

    return pd.Series([one(*row) for row in zip(text, l1, c1, l2, c2)])


def _fitting(lexeme: str, most: int) -> list[str]:
    """``lexeme`` in stretches of at most ``most`` bytes, of whole characters."""
    data, cuts = lexeme.encode(), [0]
    while len(data) - cuts[-1] > most:
        at = cuts[-1] + most
        while at > cuts[-1] and data[at] & 0xC0 == 0x80:  # inside of a character
            at -= 1
        cuts.append(at if at > cuts[-1] else next((k for k in range(cuts[-1] + 1, len(data)) if data[k] & 0xC0 != 0x80), len(data)))
    return [data[i:j].decode() for i, j in zip(cuts, [*cuts[1:], len(data)]) if i < j]


def pieces(text: str, most_bytes: int, most_tokens: int) -> list[str]:
    """``text`` in parts under both budgets, cut between lexemes, or between characters of a lexeme that is too long.

    Units are lexemes, and stretches of those that are too long, which always begin a part. A part ends where the sums of
    bytes or of tokens outgrow its beginning by their budgets, or where such a stretch begins.
    """
    sizes_of = lambda units: list(map(len, units)) if text.isascii() else [len(u) if u.isascii() else len(u.encode()) for u in units]
    units, begins = _PIECE.findall(text), []
    sizes = sizes_of(units)
    if max(sizes, default=0) > most_bytes:
        lexemes, units = units, []
        for lexeme in lexemes:
            stretches = _fitting(lexeme, most_bytes)
            begins += [len(units) + i for i in range(len(stretches)) if len(stretches) > 1]
            units += stretches
        sizes = sizes_of(units)
    bytes_to = [0, *accumulate(sizes)]
    tokens_to = [0, *accumulate(0 if u[0] in _BLANK else 1 for u in units)]  # white space stands in units of its own
    if bytes_to[-1] <= most_bytes and tokens_to[-1] <= most_tokens:
        return [text]
    begins.append(len(units))
    parts, at = [], 0
    while at < len(units):
        full = min(bisect_right(bytes_to, bytes_to[at] + most_bytes), bisect_right(tokens_to, tokens_to[at] + most_tokens)) - 1
        end = min(max(full, at + 1), begins[bisect_right(begins, at)])
        parts.append("".join(units[at:end]))
        at = end
    return parts


def split_parts(most_bytes: int = MOST_BYTES, most_tokens: int = MOST_TOKENS):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else pieces(t, most_bytes, most_tokens))

    return run


def path_key(path: Column, fold: bool = False) -> Column:
    """An absolute path without empty, ``.`` and ``..`` segments; ``fold``: in lower case, for stores that ignore case."""
    parts = F.filter(F.split(F.lower(path) if fold else path, "/"), lambda x: ~x.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, x: F.when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def stable_key(symbol: str = "symbol_usr", file: str = "file", fold: bool = False) -> Column:
    """SHA-256 of the canonical JSON of what identifies a chunk; the keys stand in a fixed, sorted order, the file as its path key."""
    fields = sorted(["schema_version", symbol, file, "chunk_kind", *COORDINATES, "part_index", "part_count"])
    value = lambda c: F.lit(1) if c == "schema_version" else path_key(F.col(c), fold) if c == file else F.col(c)
    return F.sha2(F.to_json(F.struct(*[value(c).alias(c) for c in fields]), {"ignoreNullFields": "false"}), 256)


def make_chunks(symbols: DataFrame, sources: DataFrame, most_bytes: int = MOST_BYTES, most_tokens: int = MOST_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(chunks, counts) of symbols with locations over sources (file, text): one chunk per location and one per documentation.

    Files meet by their path keys, and a chunk has the file as its source names it. Two chunks of one key raise.
    """
    at = symbols.select("stable_usr", "qualified_name", "documentation", F.explode("locations").alias("at")).select("stable_usr", "at.*")
    text = require_unique(sources.select(path_key(F.col("file")).alias("_key"), F.col("file").alias("_file"), F.col("text").alias("source")), "_key")
    found = at.join(text, path_key(at["file"]) == text["_key"], "left").withColumn("file", F.coalesce("_file", "file")).drop("_key", "_file")
    found = found.withColumn("text", source_slice("source", *COORDINATES))
    seeds = found.where(F.length("text") > 0).select(F.col("stable_usr").alias("symbol_usr"), "file", F.col("kind").alias("chunk_kind"), "text", *COORDINATES)
    order = F.transform("locations", lambda x: F.struct((x["kind"] != "definition").alias("later"), x["file"].alias("file"), x["start_line"].alias("l"), x["start_column"].alias("c"), x["kind"].alias("k")))
    documented = symbols.where((F.length(F.trim("documentation")) > 0) & (F.size("locations") > 0)).withColumn("file", F.array_min(order)["file"])
    none = [F.lit(None).cast("int").alias(c) for c in COORDINATES]
    named = documented.join(text, path_key(documented["file"]) == text["_key"]).withColumn("file", F.col("_file"))
    notes = named.select(
        F.col("stable_usr").alias("symbol_usr"), "file", F.lit("documentation").alias("chunk_kind"), F.concat("qualified_name", F.lit("\n"), F.trim("documentation")).alias("text"), *none
    )
    parts = seeds.unionByName(notes).withColumn("parts", split_parts(most_bytes, most_tokens)("text"))
    cut = parts.withColumn("part_count", F.size("parts")).select("symbol_usr", "file", "chunk_kind", *COORDINATES, "part_count", F.posexplode("parts").alias("part_index", "text"))
    chunks = stash(cut.withColumns({"stable_key": stable_key(), "content_hash": tx.content_hash(F.col("text")), "token_count": tx.token_estimate(F.col("text"))}), "chunks")
    require_unique(chunks, "stable_key")
    counts = found.agg(
        F.count(F.lit(1)).alias("source_locations"), F.count_if(F.col("source").isNull()).alias("missing_sources"),
        F.count_if(F.col("source").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)) == 0)).alias("empty_locations"),
    ).crossJoin(chunks.agg(F.count_if(F.col("part_count") > 1).alias("split_chunks")))
    return chunks, counts
