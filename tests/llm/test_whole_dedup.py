"""Near-dedup keeps one row of each group, whatever the ids are: null, repeated, or with several texts."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm import simhash

RNG = random.Random(5)
A, B, C, D, E = (" ".join(RNG.choice("abcdefghijklmnop") * RNG.randint(2, 9) + str(RNG.randint(0, 999)) for _ in range(60)) for _ in range(5))
ROWS = [
    (None, A, "x"), (None, B, "x"), (None, C, "x"),  # unrelated texts without an id: all stay
    (5, D, "x"), (None, D, "x"), (9, D, "x"),  # copies of document 5, one of them without an id
    (7, E, "x"), (7, D, "x"),  # one id with two texts, the second a copy of document 5
]


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("hash", F.lit("clash")).repartition(3)
    out = simhash.keep_first(docs)
    assert out.columns == docs.columns
    return Counter((r.doc_id, r.text, r.source) for r in out.collect())


def test_null_and_repeated_ids_keep_one_row_of_each_group(spark):
    fp = simhash.fingerprints([A, B, C, D, E])
    assert min(int(x ^ y).bit_count() for x in fp for y in fp if x != y) > 4
    got = kept(spark, ROWS)
    assert got == Counter({(None, A, "x"): 1, (None, B, "x"): 1, (None, C, "x"): 1, (5, D, "x"): 1, (7, E, "x"): 1})


def test_repeated_rows_leave_one_and_the_same_one(spark):
    rows = [*ROWS, (None, A, "b"), (None, A, "a"), (5, D, "w"), (7, E, "x"), (7, E, "x")]
    want = Counter({(None, A, "a"): 1, (None, B, "x"): 1, (None, C, "x"): 1, (5, D, "w"): 1, (7, E, "x"): 1})
    assert kept(spark, rows) == want == kept(spark, rows[::-1])
