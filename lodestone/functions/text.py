"""Column functions over code and text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript has it, words of the full-text index, and the lexemes of the token estimate.
JS_SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
TERM = "[\\p{L}\\p{N}_]+"
LEXEME = f"[A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\\.[0-9]+)?|[^{JS_SPACE}\\x00-\\x7F]|[^{JS_SPACE}A-Za-z0-9_]"


def terms(text: Column) -> Column:
    """The lower-cased words of the full-text index, in order; texts of ASCII alone are split, which costs less."""
    low = F.lower(text)
    return F.when(F.octet_length(low) == F.length(low), F.array_remove(F.split(low, "[^a-z0-9_]+"), "")).otherwise(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)))


def token_estimate(text: Column) -> Column:
    """Lexemes of code; at least 1 for a text that isn't empty."""
    found = F.size(F.regexp_extract_all(text, F.lit(LEXEME), F.lit(0)))
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), found))


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text)


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, "::"), -1)


def line_slice(text: Column, first: int, last: int) -> Column:
    """Lines ``first`` to ``last``, from 1, both included; at most 500."""
    if not (1 <= first <= last and last - first < 500):
        raise ValueError("at most 500 lines, from 1")
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def normalised(value: str, most_bytes: int) -> str:
    """A query as the signals take it: trimmed, NFC, bounded, without control characters. Raises on what is left."""
    out = unicodedata.normalize("NFC", value.strip())
    if not out or len(out.encode()) > most_bytes or any(unicodedata.category(c) == "Cc" for c in out):
        raise ValueError("invalid query text")
    return out
