"""Exact duplicates by deterministic block naming.

A text without its white space is cut into blocks of fixed size. Blocks are sorted, and equal ones, found by comparing
neighbours, get one integer as their name. Then adjacent pairs of names are named in the same way, until each document has a
single name: two documents have one name if, and only if, their texts are equal, since nothing is decided by a hash.

Texts are shuffled once, as blocks that travel with the places they stand at. Tasks that read texts send a block once for
all places they find it at within ``CHUNK`` bytes, so copies meet before the shuffle; what follows holds integers only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import as_key, from_key, stash, table

SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of a block; bytes of different blocks, and places, that a task holds before it sends them on.
BLOCK, CHUNK, PLACES = 4096, 16 << 20, 100_000
#: What stands second in a pair whose second name is missing; real names are 0 or more.
NONE = -1

_PLACE = "row long, at long, blocks long, key string, points long, sha string"
PLACED = f"block binary, places array<struct<{', '.join(x.replace(' ', ': ') for x in _PLACE.split(', '))}>>"


def normalised(text) -> bytes:
    """UTF-8 of a text without ``[\\x20\\x09-\\x0D]``; null is empty."""
    return text.encode("utf-8", "surrogatepass").translate(None, SPACE) if isinstance(text, str) else b""


def _cut(block: int, chunk: int):
    """Blocks and where they stand. Rows are numbered by task and place, which a repeated task repeats."""

    def run(batches):
        row, held, size, places = TaskContext.get().partitionId() << 33, {}, 0, 0
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"]):
                data = normalised(text)
                told = (key, len(text) if isinstance(text, str) else 0, hashlib.sha256(data).hexdigest())
                blocks = max(1, -(-len(data) // block))
                for at in range(blocks):
                    piece = data[at * block : (at + 1) * block]
                    if piece not in held:
                        held[piece] = []
                        size += len(piece)
                    held[piece].append((row, at, blocks, *(told if at == 0 else (None, None, None))))
                    places += 1
                    if size >= chunk or places >= PLACES:
                        yield pd.DataFrame({"block": list(held), "places": list(held.values())})
                        held, size, places = {}, 0, 0
                row += 1
        if held:
            yield pd.DataFrame({"block": list(held), "places": list(held.values())})

    return run


def _name_blocks(batches):
    """Names sorted blocks: the next integer of this task wherever a block differs from the one before it."""
    name, last = (TaskContext.get().partitionId() << 33) - 1, None
    for pdf in batches:
        blocks, names = pdf["block"], np.empty(len(pdf), np.int64)
        for i, b in enumerate(blocks):
            if b != last:
                name, last = name + 1, b
            names[i] = name
        yield pd.DataFrame({"name": names, "places": pdf["places"]})


def name_blocks(docs: DataFrame, id_col: str = "doc_id", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(row, at, blocks, key, points, sha, name): the named blocks of each row; the row's facts stand at its first block."""
    placed = docs.select(as_key(id_col), "text").mapInPandas(_cut(block, chunk), PLACED)
    in_order = placed.repartition("block").sortWithinPartitions("block")
    named = in_order.mapInPandas(_name_blocks, f"name long, {PLACED.split(', ', 1)[1]}")
    return named.select("name", F.inline("places"))


def name_pairs(names: DataFrame) -> DataFrame:
    """The next level: (row, at, blocks, name) of adjacent pairs. Pairs are sorted and numbered once each, then joined back."""
    second = F.max(F.when(F.col("at") % 2 == 1, F.col("name")))
    pairs = names.groupBy("row", F.floor(F.col("at") / 2).alias("at"), F.ceil(F.col("blocks") / 2).alias("blocks"))
    pairs = stash(pairs.agg(F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(second, F.lit(NONE)).alias("b")), "pairs")
    numbered = pairs.groupBy("a", "b").agg(F.lit(0).alias("z")).sortWithinPartitions("a", "b").select("a", "b", F.monotonically_increasing_id().alias("name"))
    return pairs.join(stash(numbered, "numbered"), ["a", "b"]).select("row", "at", "blocks", "name")


def identities(docs: DataFrame, id_col: str = "doc_id", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(row, key, points, sha, level, name): (level, name) is the same for equal texts and for no others."""
    named = stash(name_blocks(docs, id_col, block, chunk), "blocks")
    facts = ["row", "key", "points", "sha"]
    out = named.where("blocks = 1").select(*facts, F.lit(0).alias("level"), "name")
    names, done, level = named.where("blocks > 1").select("row", "at", "blocks", "name"), None, 0
    while not names.isEmpty():
        names, level = stash(name_pairs(names), "names"), level + 1
        ended = names.where("blocks = 1").select("row", F.lit(level).alias("level"), "name")
        done, names = ended if done is None else done.unionByName(ended), names.where("blocks > 1")
    if done is None:
        return out
    return out.unionByName(named.where("blocks > 1 and at = 0").select(*facts).join(done, "row"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are so without white space; null and white space alone count as empty, and are equal. Of equal
    texts the row with most code points stays, then that of the smallest id (nulls last), then the first read: so one row
    stays of rows that repeat altogether. Other columns are not read. An empty table has no rows.
    """
    rows = stash(from_key(identities(docs, id_col, block, chunk), docs, id_col, "key"), "identities")
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("key").isNull().alias("none"), "key", "row")).alias("best")
    groups = rows.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), best)
    groups = stash(groups.select("level", "name", "group_size", F.col("best.key").alias("keep_id"), F.col("best.row").alias("keep_row")), "groups")
    out = rows.join(groups, ["level", "name"])  # of two stored tables, so that Spark may split a large group
    return out.select(F.col("key").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH docs AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body, row_number() OVER () AS row FROM documents),
ranked AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size
  FROM docs WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST, row))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM ranked
"""
