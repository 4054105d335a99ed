"""Source divergence audit: how far apart the sources of a language are in the words that they use.

Plain relational work: matches are exploded and counted by (language, source, term), the terms of a language that stand in
enough of its documents are kept, each group is crossed with the kept terms of its language so that terms it lacks count as
zero, and shares are compared by a self-join on language and term. Everything after the count of terms is as large as the
groups times the kept vocabulary, not as the corpus. Counting combines in the tasks that read the texts; languages are cut
by a hash of the term, so that one that holds most rows is no single task's; only sums and ranks of a group meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import lower_ascii, stash, table

#: Runs of letters: every character but ASCII's other ones.
TERM = "[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Documents of a language that a kept term stands in; what is added to each count; units of a share; terms told of a group.
LEAST, ADDED, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Parts that a language's vocabulary is cut into where it meets the language's groups.
SALT = 64


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term. Every row is a document of its own.

    A document's terms and its distinct terms leave one explode behind each other; what stands after the former marks a
    document, so texts are read once and nothing but sums by group and term is shuffled.
    """
    found = F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))
    rows = _named(docs).select("lang", "source", found.alias("found"))
    both = rows.select("lang", "source", F.size("found").alias("size"), F.posexplode(F.concat("found", F.array_distinct("found"))).alias("at", "term"))
    n, in_docs = F.count_if(F.col("at") < F.col("size")), F.count_if(F.col("at") >= F.col("size"))
    return both.groupBy("lang", "source", "term").agg(n.alias("n"), in_docs.alias("docs"))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")])


def share(n: Column, total: Column, terms: Column, unit: int = UNIT, added: int = ADDED) -> Column:
    """1 + floor(unit * (n + added) / (total + added * terms)), exact for any count: products are decimals of 38 digits."""
    wide = (n + F.lit(added)).cast("decimal(20,0)") * F.lit(unit).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, (total + F.lit(added) * terms).cast("decimal(20,0)"))


def shares(docs: DataFrame, least: int = LEAST, salt: int = SALT) -> tuple[DataFrame, DataFrame]:
    """(groups: lang, source, terms; dense: lang, source, term, n, p, q), p the group's share of a kept term, q the language's.

    Each group has a row for each kept term of its language, whether it holds it or not.
    """
    by_term = Window.partitionBy("lang", "term")
    known = counts(docs).withColumn("lang_docs", F.sum("docs").over(by_term)).where(F.col("lang_docs") >= least)
    kept = stash(known.withColumn("lang_n", F.sum("n").over(by_term)).select("lang", "source", "term", "n", "lang_n"), "kept")
    vocabulary = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n"))
    by_lang = vocabulary.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    by_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _named(docs).groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    groups = groups.join(by_lang, "lang", "left").join(by_group, ["lang", "source"], "left").fillna(0, ["lang_total", "terms", "total"])
    groups = stash(groups, "groups")
    part = F.pmod(F.xxhash64("term"), F.lit(salt)).cast("int")
    copies = groups.where("terms > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    crossed = vocabulary.withColumn("part", part).join(copies, ["lang", "part"]).drop("part")
    dense = crossed.join(kept.drop("lang_n"), ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    return groups, stash(dense.select("lang", "source", "term", "n", p.alias("p"), q.alias("q")), "dense")


def pairs(groups: DataFrame, dense: DataFrame) -> DataFrame:
    """(lang, source, item, value): for each two sources of a language, both ways, the sum of their shares' differences."""
    one, two = dense.select("lang", "term", "source", "p"), dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    apart = one.join(two, ["lang", "term"]).where(F.col("source") < F.col("item"))
    sums = apart.groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("value"))
    bare = groups.where("terms = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").where(F.col("source") < F.col("item")).withColumn("value", F.lit(0).cast("long"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return sums.unionByName(none).select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.source", "way.item", "value")


def audit(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources by distance (`pair`) and the terms used too often (`term`).

    Null text, lang and source count as empty, the empty names being a language and a source like others. Repeated rows are
    documents of their own; documents without terms still make their group. An empty table has no rows. No other column is
    read. Of equal values the item that comes first in UTF-8 has the lower rank.
    """
    groups, dense = shares(docs, least)
    over = dense.where((F.col("n") > 0) & (F.col("p") > F.col("q")))
    terms = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    both = pairs(groups, dense).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item")))
    return both.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents),
held AS (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs),
vocabulary AS (SELECT lang, term FROM held GROUP BY lang, term HAVING count(*) >= 30),
occurring AS (SELECT lang, source, unnest(terms) AS term FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM occurring JOIN vocabulary USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM groups JOIN vocabulary USING (lang) LEFT JOIN counted USING (lang, source, term)),
wide AS (
  SELECT lang, source, term, n, sum(n) OVER (PARTITION BY lang, source) AS total, sum(n) OVER (PARTITION BY lang, term) AS lang_n,
    sum(n) OVER (PARTITION BY lang) AS lang_total, count(*) OVER (PARTITION BY lang, source) AS v
  FROM cells),
priced AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (total::HUGEINT + 5 * v) AS p, 1 + (1000000000 * (lang_n::HUGEINT + 5)) // (lang_total::HUGEINT + 5 * v) AS q
  FROM wide),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM priced WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
