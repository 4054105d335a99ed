"""Helpers shared by the training-data operators: word splitting, hashes of ids; storage is the library's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import storage
from lodestone.storage import new_path, stash

__all__ = ["SPACE_GAP", "WORD_GAP", "again", "as_key", "crc_remainder", "from_key", "lower_ascii", "new_path", "split_words", "stash", "table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words of letters and digits: every ASCII character that is neither a lower-case letter nor a digit.
WORD_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: What separates tokens: ASCII white space.
SPACE_GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's, at least a task for each core."""
    return storage.spread(storage.table(spark, sf_dir, name))


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and all else as it is; pure ASCII takes the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, gap: str) -> Column:
    """The runs between ``gap``s; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def as_key(id_col: str) -> Column:
    """The id as text, as it travels through pandas: a column of numbers with nulls would become floats there."""
    return F.col(id_col).cast("string").alias("key")


def from_key(out: DataFrame, docs: DataFrame, id_col: str, name: str | None = None) -> DataFrame:
    """``out`` with its text key turned back into the id of ``docs``, under ``name`` (the id's own)."""
    return out.withColumn("key", F.col("key").cast(docs.schema[id_col].dataType)).withColumnRenamed("key", name or id_col)


#: Rows that are made of one row at once where it stands for many.
AT_ONCE = 10_000


def again(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as ``times`` says (at least once), in steps that no row's array outgrows."""
    n = F.greatest(F.col(times), F.lit(1))
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / AT_ONCE)))
    return df.withColumn("_part", parts).withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(AT_ONCE).cast("long"), n - F.col("_part") * AT_ONCE)))).drop("_part", "_again")
