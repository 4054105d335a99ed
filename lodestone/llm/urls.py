"""URL filter by a path-template tree, in DataFrame operations only.

Per host, paths are laid into a tree, segment by segment. The branches of a node are its frequent literal segments with
enough labelled pages, and a wildcard of all others: segments with a digit, rare ones, those without labels. Branches
are ordered by labelled purity, and neighbours that a two-proportion test doesn't tell apart are merged; what is merged
with the wildcard, or is all there is, becomes a wildcard. The tree goes down as long as a node has labelled pages of
both kinds, enough of them for any branch to differ, and further segments; the rest of a path is one wildcard. A
template's purity is the share of good labelled pages, smoothed towards its host's, and that towards the whole table's.
Templates of too low purity are rejected. Fixed allow and block rules stand above the templates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, UPPER, stash, table

#: Fixed values of the contract: rules (host and path) and their verdicts.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: The least share of a literal; the test's z, and the labelled pages that it needs; pages that a prior is worth; the purity
#: below which a template is rejected.
SHARE, Z, LEAST, PRIOR, PURITY = 0.05, 2.576, 7, 10.0, 0.5
#: Characters of templates, which a backslash tells apart from those of a path.
MARKS = r"([\\*{}|])"


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits (ties: the first by text), or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):  # later ones take precedence
        at, _, begin = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{begin}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _purity(good: Column, n: Column, prior: Column) -> Column:
    return (good + PRIOR * prior) / (n + PRIOR)


def _names(child: DataFrame) -> DataFrame:
    """(at, is, name): the literal branches of nodes that are told apart from the wildcard, by the names of what they merge to.

    A node has 1 / SHARE literal branches at most, and a wildcard: sums by node and branch leave so many rows to order, however
    many segments a node has.
    """
    parent = Window.partitionBy("node")
    own = child.join(stash(child.groupBy("node").agg(F.sum("n").alias("all_n")), "nodes"), "node")
    literal = F.col("value").isNotNull() & (F.col("n") >= SHARE * F.col("all_n")) & (F.col("m") >= LEAST)
    branch = own.where(literal | ~F.col("ended")).groupBy("node", F.when(literal, F.col("value")).alias("value")).agg(F.sum("m").alias("m"), F.sum("g").alias("g"))
    order = Window.partitionBy("node").orderBy(F.col("g") / F.col("m"), F.col("value").asc_nulls_last())
    before = lambda c: F.lag(c).over(order)
    pooled = (F.col("g") + before("g") + 1) / (F.col("m") + before("m") + 2)
    z = (F.col("g") / F.col("m") - before("g") / before("m")) / F.sqrt(pooled * (1 - pooled) * (1 / F.col("m") + 1 / before("m")))
    grouped = branch.where(F.col("m") >= LEAST).withColumn("apart", F.when(z > Z, 1).otherwise(0)).withColumn("group", F.sum("apart").over(order))
    merged = grouped.groupBy("node", "group").agg(F.array_sort(F.collect_list("value")).alias("values"), F.count_if(F.col("value").isNull()).alias("wild"))
    merged = merged.withColumn("groups", F.count(F.lit(1)).over(parent)).where((F.col("wild") == 0) & (F.col("groups") > 1))
    plain = F.transform("values", lambda x: F.regexp_replace(x, MARKS, r"\\$1"))
    name = F.when(F.size("values") == 1, F.get(plain, F.lit(0))).otherwise(F.concat(F.lit("{"), F.array_join(plain, "|"), F.lit("}")))
    return merged.select(F.col("node").alias("at"), F.explode("values").alias("is"), name.alias("name"))


def templates(pages: DataFrame) -> DataFrame:
    """``pages`` (host, path, good: 1, 0 or null) with ``template``: host and generalised path."""
    rows = pages.withColumn("seg", F.filter(F.split("path", "/"), lambda x: x != "")).withColumn("node", F.col("host"))
    done, level = None, 0
    tail = lambda df: df.withColumn("template", F.concat("node", F.when(F.size("seg") > level, F.lit("/**")).otherwise(F.lit("")))).drop("node", "seg")
    while True:
        part = F.get("seg", F.lit(level))
        value = F.when(part.rlike("[0-9]"), F.lit(None)).otherwise(part)
        rows = rows.withColumn("value", value).withColumn("ended", part.isNull())
        good = F.coalesce(F.sum("good"), F.lit(0)).cast("double")
        child = stash(rows.groupBy("node", "value", "ended").agg(F.count(F.lit(1)).alias("n"), F.count("good").alias("m"), good.alias("g")), "branches")
        every = child.groupBy("node").agg(F.sum("m").alias("m"), F.sum("g").alias("g"), F.min("ended").alias("ended"))
        mixed = stash(every.where((F.col("m") >= LEAST) & (F.col("g") > 0) & (F.col("g") < F.col("m")) & ~F.col("ended")).select(F.col("node").alias("open")), "mixed")
        if mixed.isEmpty():
            last = tail(rows.drop("value", "ended"))
            return last if done is None else done.unionByName(last)
        goes = rows.join(mixed, rows["node"] == mixed["open"], "left")
        closed = tail(goes.where("open is null").drop("open", "value", "ended"))
        done = closed if done is None else done.unionByName(closed)
        names = stash(_names(child.join(mixed, child["node"] == mixed["open"], "left_semi")), "names")
        on = goes.where("open is not null").join(names, (F.col("node") == F.col("at")) & (F.col("value") == F.col("is")), "left")
        step = F.when(F.col("ended"), F.lit("")).otherwise(F.concat(F.lit("/"), F.coalesce("name", F.lit("*"))))
        rows = stash(on.withColumn("node", F.concat("node", step)).drop("open", "at", "is", "name", "value", "ended"), "level")
        level += 1


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] = RULES) -> DataFrame:
    """Per row of ``pages``: ``id_col``, host, path, rule, verdict, template, purity.

    ``labels`` has ``id_col`` and good (1 or 0); pages without one have no label, several labels of a page count as bad
    if one is. Null urls and those without ``://`` have an empty host and path and one template. Templates without
    labels get their host's purity. Repeated rows each get their row; other columns are not read.
    """
    host, path = parts(F.col(url_col))
    mine = pages.select(F.col(id_col).alias("key"), host.alias("host"), path.alias("path"))
    known = labels.where(F.col("good").isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg(F.min("good").cast("long").alias("good"))
    rows = templates(stash(mine.join(known, F.col("key") == F.col("labelled"), "left").drop("labelled"), "pages"))
    rows = stash(rows, "templates")
    by = stash(rows.groupBy("template", "host").agg(F.count("good").alias("m"), F.coalesce(F.sum("good"), F.lit(0)).alias("g")), "by-template")
    whole = by.agg((F.coalesce(F.sum("g"), F.lit(0)) + 1).alias("whole_g"), (F.coalesce(F.sum("m"), F.lit(0)) + 2).alias("whole_m"))
    of_host = by.groupBy(F.col("host").alias("h")).agg(F.sum("m").alias("hm"), F.sum("g").alias("hg")).crossJoin(F.broadcast(whole))  # whole: one row
    of_host = of_host.select("h", _purity(F.col("hg"), F.col("hm"), F.col("whole_g") / F.col("whole_m")).alias("prior"))
    pure = by.join(of_host, F.col("host") == F.col("h")).select(F.col("template").alias("t"), _purity(F.col("g"), F.col("m"), F.col("prior")).alias("purity"))
    out = rows.join(stash(pure, "purities"), F.col("template") == F.col("t")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = F.element_at(F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]), F.col("rule")) if rules else F.lit(None).cast("string")
    verdict = F.coalesce(ruled, F.when(F.col("purity") < PURITY, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("key").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, good): the labels of the document whose number ends the page's path; good: of quality and not toxic."""
    _, path = parts(F.col("url"))
    number = F.regexp_extract(path, "/([0-9]{1,18})(?:\\.[a-z]+)?/?$", 1)
    ids = pages.select("page_id", F.when(number != "", number.cast("long")).alias("doc")).where("doc is not null")
    good = F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int"))
    return ids.join(labels.groupBy(F.col("doc_id").alias("doc")).agg(good.alias("good")), "doc").select("page_id", "good")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, page_labels(pages, table(spark, sf_dir, "labels"))).drop("template", "purity")


def _oracle() -> str:
    rules = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in RULES.items())
    return f"""
WITH RECURSIVE rules(rule, h, b, verdict) AS (VALUES {rules}),
p AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS x FROM pages),
q AS (SELECT page_id, r, translate(regexp_extract(x, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(x, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM p),
l AS (SELECT doc_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good FROM labels GROUP BY doc_id),
s AS (SELECT q.page_id, q.r, host, path, good FROM q LEFT JOIN l ON l.doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:\\.[a-z]+)?/?$', 1) AS BIGINT)),
g AS (SELECT page_id, min(good) AS good FROM s WHERE good IS NOT NULL GROUP BY page_id),
t AS (
  SELECT q.page_id, r, host, path, g.good, [x FOR x IN string_split(path, '/') IF x <> ''] AS seg, 0 AS level, host AS node, true AS active FROM q LEFT JOIN g USING (page_id)
  UNION ALL (
  WITH v AS (SELECT *, seg[level + 1] IS NULL AS ended, CASE WHEN regexp_matches(seg[level + 1], '[0-9]') THEN NULL ELSE seg[level + 1] END AS value FROM t WHERE active),
  o AS (SELECT node AS open FROM v GROUP BY node HAVING count(good) >= {LEAST} AND sum(good) > 0 AND sum(good) < count(good) AND NOT bool_and(ended)),
  c AS (SELECT node, value, ended, count(*) AS n, count(good) AS m, coalesce(sum(good), 0)::DOUBLE AS g, sum(count(*)) OVER (PARTITION BY node) AS nn FROM v JOIN o ON node = open GROUP BY node, value, ended),
  l AS (SELECT *, value IS NOT NULL AND n >= {SHARE} * nn AND m >= {LEAST} AS literal FROM c),
  b AS (SELECT node, CASE WHEN literal THEN value END AS value, sum(m) AS m, sum(g) AS g FROM l WHERE literal OR NOT ended GROUP BY ALL HAVING sum(m) >= {LEAST}),
  w AS (SELECT *, lag(m) OVER x AS m0, lag(g) OVER x AS g0 FROM b WINDOW x AS (PARTITION BY node ORDER BY g / m, value NULLS LAST)),
  s AS (SELECT *, sum(CASE WHEN (g / m - g0 / m0) / sqrt((g + g0 + 1) / (m + m0 + 2) * (1 - (g + g0 + 1) / (m + m0 + 2)) * (1 / m + 1 / m0)) > {Z} THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY g / m, value NULLS LAST) AS grp FROM w),
  k AS (SELECT node, grp, list_sort(list(value)) AS vals, count(*) - count(value) AS wild, count(*) OVER (PARTITION BY node) AS n FROM s GROUP BY node, grp),
  y AS (SELECT *, [regexp_replace(x, '{MARKS}', '\\\\\\1', 'g') FOR x IN vals] AS said FROM k),
  a AS (SELECT node AS home, unnest(vals) AS literal, CASE WHEN len(vals) = 1 THEN said[1] ELSE '{{' || array_to_string(said, '|') || '}}' END AS name FROM y WHERE wild = 0 AND n > 1)
  SELECT page_id, r, host, path, good, seg, CASE WHEN open IS NULL THEN level ELSE level + 1 END AS level,
    CASE WHEN open IS NULL THEN node || CASE WHEN ended THEN '' ELSE '/**' END WHEN ended THEN node ELSE node || '/' || coalesce(name, '*') END AS node, open IS NOT NULL AS active
    FROM v LEFT JOIN o ON node = open LEFT JOIN a ON node = home AND value = a.literal)),
m AS (SELECT *, node AS template FROM t WHERE NOT active),
b AS (SELECT template, host, count(good) AS m, coalesce(sum(good), 0) AS g FROM m GROUP BY template, host),
h AS (SELECT host, (sum(g) + {PRIOR} * ((SELECT sum(g) + 1 FROM b) / (SELECT sum(m) + 2 FROM b))) / (sum(m) + {PRIOR}) AS prior FROM b GROUP BY host),
u AS (SELECT template, (g + {PRIOR} * prior) / (m + {PRIOR}) AS purity FROM b JOIN h USING (host)),
f AS (SELECT r, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM q JOIN rules ON (q.host = h OR ends_with(q.host, '.' || h)) AND starts_with(q.path, b) GROUP BY r)
SELECT page_id, host, path, f.rule, coalesce(f.verdict, CASE WHEN purity < {PURITY} THEN 'block' ELSE 'allow' END) AS verdict FROM m JOIN u USING (template) LEFT JOIN f USING (r)
"""


ORACLE_SQL = _oracle()
