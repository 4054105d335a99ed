"""License scan by diagonal voting, in DataFrame operations only.

All rolling word bigrams of the texts join the places of the same bigrams in license templates. Each match votes for
the diagonal (word place minus template place) of its template; votes are summed by diagonal, diagonals that lie close
together are merged into a band, and a band is a span of the template if its verified words cover enough of it and hold
the words that tell it from its like. Of overlapping spans the best covered one labels. Base phrases are templates as
well: they are found where one diagonal holds every bigram of the phrase.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.common import WORD_GAP, again, lower_ascii, split_words, table

#: The base phrases, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Public license notices and texts with the labels of the method; the words in brackets must stand in a span.
NOTICES = [
    ("apache-2.0", "Licensed under the Apache License, [Version 2].0"),
    ("gpl-3.0", "Licensed under the GNU General Public License [version 3]"),
    ("gpl-2.0", "Licensed under the GNU General Public License [version 2]"),
    ("lgpl", "Licensed under the GNU [Lesser General] Public License"),
    ("cc-by-4.0", "Licensed under CC [BY 4].0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-[NC 4].0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-[SA 4].0"),
    ("mit-release", "Released under the [MIT License]"),
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, [v. 2].0"),
    ("apache-2.0-text", """Licensed under the Apache License, [Version 2].0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
License for the specific language governing permissions and limitations under the License."""),
    ("gpl-3.0-text", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either [version 3] of the License, or (at your option) any later version. This program is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
General Public License for more details. You should have received a copy of the GNU General Public License along with this program."""),
    ("gpl-2.0-text", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation; either [version 2] of the License, or (at your option) any later version. This program is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
General Public License for more details. You should have received a copy of the GNU General Public License along with this program."""),
    ("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The
above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc-text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib-text", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you
wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or
altered from any source distribution."""),
]
#: Words so frequent that a bigram of two of them is no evidence.
COMMON = ("the", "of", "to", "and", "in", "is", "a", "this", "for", "that", "under", "with", "or", "any")
#: Words of a rolling gram; how far apart merged diagonals may lie; the share of a template's bigrams that a band must cover.
GRAM, GAP, COVER = 2, 3, 0.8


def grams() -> list[tuple]:
    """(template, label, base, place, the two words, grams of the template, grams that must stand, whether this one must)."""
    rows = []
    for t, (label, text) in enumerate([*((label, phrase) for phrase, label in BASE.items()), *NOTICES]):
        marked = re.findall("[a-z0-9]+|[][]", text.lower())
        words, needed, inside = [], set(), False
        for w in marked:
            if w in "[]":
                inside = w == "["
            else:
                needed |= {len(words)} if inside else set()
                words.append(w)
        base = t < len(BASE)
        must = {i for i in needed if i + 1 in needed}
        pairs = [(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:])) if base or i in must or not (a in COMMON and b in COMMON)]
        rows += [(t, label, base, i, a, b, len(pairs), len(must), i in must) for i, a, b in pairs]
    return rows


def templates(spark: SparkSession) -> DataFrame:
    """One row per distinct bigram: its hash and its places in the templates."""
    places = spark.createDataFrame(grams(), "t int, label string, base boolean, i int, a string, b string, n int, n_must int, must boolean")
    return places.groupBy(F.xxhash64("a", "b").alias("g")).agg(F.collect_list(F.struct(*places.columns)).alias("places"))


def scan(docs: DataFrame, id_col: str = "doc_id", gap: int = GAP, cover: float = COVER) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` is an array of the verified spans (first word, last word, label, share of the template covered): bands that
    cover enough of their template and all of its bracketed words. Where spans of the method's templates overlap, only
    the one with most verified grams labels (then the larger share, then the earlier template). Null or empty texts have
    no words, zero counts and empty label lists. Repeated rows each get their row; other columns are not read. The
    template table has a fixed size (about a thousand bigrams), so it is broadcast.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(F.col(id_col).alias("key"), F.xxhash64(text).alias("h"), split_words(lower_ascii(text), WORD_GAP).alias("words"))
    placed = words.select("key", "h", "words", F.posexplode_outer("words").alias("pos", "w"))
    placed = placed.withColumn("v", F.get("words", F.col("pos") + 1)).withColumn("g", F.when(F.col("v").isNotNull(), F.xxhash64("w", "v")))
    first = F.col("pos").isNull() | (F.col("pos") == 0)  # stands for the document: counts its words and its repeats
    joined = placed.join(F.broadcast(templates(docs.sparkSession)), "g", "left").where(first | F.col("places").isNotNull())
    n_words = F.greatest(F.size("words"), F.lit(0)).cast("long")
    hits = joined.select("key", "h", n_words.alias("n_words"), "pos", "w", "v", "places", first.alias("first"))

    word, no = F.lit(None).cast("string"), F.lit(False)
    mark = F.array(F.struct(F.lit(-1).alias("t"), word.alias("label"), no.alias("base"), F.lit(0).alias("i"), word.alias("a"), word.alias("b"), F.lit(1).alias("n"), F.lit(0).alias("n_must"), no.alias("must")))
    none = F.filter(mark, lambda x: F.lit(False))
    true = F.filter(F.coalesce("places", none), lambda x: (x["a"] == F.col("w")) & (x["b"] == F.col("v")))
    votes = hits.select("key", "h", "n_words", "pos", F.explode(F.concat(F.when(F.col("first"), mark).otherwise(none), true)).alias("p"))
    diagonal = F.when(F.col("p.t") >= 0, F.col("pos") - F.col("p.i")).otherwise(0)
    by = ["key", "h", "n_words", "t", "label", "base", "n", "n_must"]
    # Repeated rows are added up before the shuffle; after it a document has a row per diagonal.
    diagonals = (
        votes.select("key", "h", "n_words", "p.*", diagonal.alias("d")).groupBy(*by, "d")
        .agg(F.collect_set("i").alias("voted"), F.collect_set(F.when(F.col("must"), F.col("i"))).alias("musts"), F.count(F.lit(1)).alias("votes"))
        .repartition("key", "h")
    )
    near = Window.partitionBy(*by).orderBy("d")
    apart = F.col("base") | (F.col("d") - F.lag("d").over(near) > gap)  # base phrases stand on one diagonal
    bands = diagonals.withColumn("band", F.sum(F.when(apart, 1).otherwise(0)).over(near)).groupBy(*by, "band").agg(
        F.array_distinct(F.flatten(F.collect_list("voted"))).alias("voted"), F.array_distinct(F.flatten(F.collect_list("musts"))).alias("musts"), F.max("votes").alias("votes"),
        F.min(F.col("d") + F.array_min("voted")).cast("long").alias("from"), F.max(F.col("d") + F.array_max("voted") + GRAM - 1).cast("long").alias("to"),
    )
    share = F.size("voted") / F.col("n")
    enough = F.when(F.col("base"), F.size("voted") == F.col("n")).otherwise((share >= cover) & (F.size("musts") == F.col("n_must")))
    judged = bands.select(*by, "band", "votes", "from", "to", share.alias("share"), F.size("voted").alias("held"), ((F.col("t") >= 0) & enough).alias("found"))
    # Each word of the method's spans goes to the best of them; a span labels if it has all its words. Others take no part.
    method = F.col("found") & ~F.col("base")
    spread = judged.withColumn("at", F.explode(F.when(method, F.sequence("from", "to")).otherwise(F.array(F.lit(-1).cast("long")))))
    rank = F.struct(F.col("held"), F.col("share"), (-F.col("t")).alias("t"), (-F.col("from")).alias("from"))
    best = F.max(rank).over(Window.partitionBy("key", "h", "at"))
    won = spread.withColumn("mine", (F.col("at") < 0) | (best == rank)).groupBy(*by, "band", "votes", "from", "to", "share", "found").agg(F.min("mine").alias("mine"))
    base, labels = F.col("found") & F.col("base"), F.col("found") & F.col("mine")
    # A band of n bigrams holds its phrase once; collect_* and min skip the nulls of all others.
    per = won.groupBy("key", "h", "n_words").agg(
        F.max(F.when(F.col("t") < 0, F.col("votes"))).alias("repeats"),
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("from"))).alias("first_word"), F.max(F.when(base, F.col("from"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(labels, F.col("label")))), ",").alias("labels"),
        F.max(F.when(F.col("t") < 0, F.lit(0.0)).when(labels, F.col("share")).otherwise(F.col("share") / 2)).alias("score"),
        F.array_sort(F.collect_list(F.when(labels, F.struct(F.col("from").alias("first"), F.col("to").alias("last"), "label", "share")))).alias("spans"),
    )
    return again(per, "repeats").select(F.col("key").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


def _oracle() -> str:
    """The definition over word lists: votes by diagonal, bands, verified spans, and those that no better one overlaps."""
    rows = [f"({t}, '{label}', {base}, {i}, '{a} {b}', {n}, {n_must}, {must})" for t, label, base, i, a, b, n, n_must, must in grams()]
    return f"""
WITH tpl(t, label, base, i, g, n, n_must, must) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT r, p - 1 AS p, w[p] || ' ' || w[p + 1] AS g FROM (SELECT r, w, unnest(range(1, len(w))) AS p FROM d)),
v AS (SELECT r, t, label, base, n, n_must, i, must, p - i AS d FROM g JOIN tpl USING (g)),
k AS (SELECT r, t, d, sum(CASE WHEN base OR d - before > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY r, t ORDER BY d) AS band
  FROM (SELECT r, t, base, d, lag(d) OVER (PARTITION BY r, t ORDER BY d) AS before FROM (SELECT DISTINCT r, t, base, d FROM v))),
c AS (SELECT r, t, label, base, band, count(DISTINCT i) AS held, count(DISTINCT i) / n AS share, min(d + i) AS f, max(d + i + 1) AS l,
  CASE WHEN base THEN count(DISTINCT i) = n ELSE count(DISTINCT i) / n >= {COVER} AND count(DISTINCT CASE WHEN must THEN i END) = n_must END AS found FROM v JOIN k USING (r, t, d) GROUP BY r, t, label, base, n, n_must, band),
e AS (SELECT *, found AND (base OR NOT EXISTS (SELECT 1 FROM c o WHERE o.r = c.r AND o.found AND NOT o.base AND o.f <= c.l AND c.f <= o.l
  AND (o.held, o.share, -o.t, -o.f) > (c.held, c.share, -c.t, -c.f))) AS labels FROM c),
a AS (SELECT r, count(*) FILTER (found AND base) AS n_base, min(f) FILTER (found AND base) AS first_word, max(f) FILTER (found AND base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (found AND base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (labels) AS labels,
  max(CASE WHEN labels THEN share ELSE share / 2 END) AS score FROM e GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (r)
"""


ORACLE_SQL = _oracle()
