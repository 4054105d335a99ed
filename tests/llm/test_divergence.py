"""The divergence audit against plain Python with whole numbers."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestone.llm import divergence

DOCS = "text string, lang string, source string"
ROWS = (
    [("The cat, the DOG. Été été 2x", "en", s) for s in ("a", "a", "b", "ü", None)]
    + [("cat " * 500 + "dog", "en", "a"), (None, "en", "c"), ("", "en", "c"), ("rare once", "en", "b"), ("dog dog cat", "en", "z"), ("Ab ab AB", None, "a"), ("ab zz", "", "b"), ("ab", None, None)]
    + [("12 ..", "de", "x"), (None, "de", "y"), (None, None, "solo"), ("eins", "xx", None), ("tie tie", "en", "t1"), ("tie tie", "en", "t2")]
)


def want(rows, least, top):
    docs = [(l or "", s or "", ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]) for t, l, s in rows]
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), {(l, s) for l, s, _ in docs}
    for l, s, words in docs:
        held[l].update(set(words))
        counts[l, s].update(words)
    out = []
    for l in {l for l, _ in groups}:
        kept = {t for t, n in held[l].items() if n >= least}
        mine = [s for k, s in groups if k == l]

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 5) // total for t in kept}

        p = {s: shares(counts[l, s]) for s in mine}
        q = shares(sum((counts[l, s] for s in mine), Counter()))
        for s in mine:
            pair = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in mine if o != s]
            term = [(t, p[s][t] - q[t]) for t in kept if counts[l, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(l, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def test_against_plain_python(spark):
    df = spark.createDataFrame(list(ROWS), DOCS).withColumns({c: F.lit("clash") for c in ("term", "n", "docs", "item", "value", "rank", "part", "found")}).repartition(3)
    for least, top in ((2, 50), (1, 2), (1000, 50)):
        got = divergence.audit(df, top=top, least=least).select("lang", "source", "part", "item", "value", "rank").collect()
        assert sorted(map(tuple, got)) == want(ROWS, least, top)


def test_shares_of_counts_beyond_64_bits(spark):
    row = spark.range(1).select(divergence.share(F.lit(9_000_000_000_000_000_000), F.lit(9_100_000_000_000_000_000), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 10**9 * (9_000_000_000_000_000_000 + 5) // (9_100_000_000_000_000_000 + 35)


def test_empty_table_and_repeated_rows(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    twice = spark.createDataFrame(list(ROWS) * 2, DOCS)
    assert sorted(map(tuple, divergence.audit(twice, least=4).select("lang", "source", "part", "item", "value", "rank").collect())) == want(list(ROWS) * 2, 4, 50)
