"""License labels against a list made by hand: each notice has its own label, and none of its like."""

import re

import pytest

from lodestone.llm import licenses

BY_HAND = [
    ("Licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("Licensed under the GNU General Public License, version 2.", "gpl,gpl-2.0"),
    ("Licensed under the GNU Lesser General Public License.", "lgpl"),
    ("Licensed under the GNU General Public License.", "gpl"),
    ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa-4.0"),
    ("Licensed under CC BY 4.0", "cc-by,cc-by-4.0"),
    ("Licensed under the Apache License, Version 2.0", "apache,apache-2.0"),
    ("Licensed under the Apache License, Version 1.1", "apache"),
    ("Released under the MIT License.", "mit,mit-release"),
    ("Licensed under CC BY 4.0 and, for code, released under the MIT license", "cc-by,cc-by-4.0,mit,mit-release"),
    ("The general public, a license and the version 2 of a song.", ""),
    ("Licensed under the GNU General Public License version 2. Licensed under the GNU General Public License version 3.", "gpl,gpl-2.0,gpl-3.0"),
]


def test_each_notice_has_its_own_label(spark):
    rows = [(i, text) for i, (text, _) in enumerate(BY_HAND)]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(BY_HAND))] == [labels for _, labels in BY_HAND]


@pytest.mark.parametrize("change", ["none", "a word in twenty replaced", "cut in half"])
def test_whole_texts(spark, change):
    """Each template's text names its own label (and base labels); small changes don't hide it; half a text isn't it."""
    rows, want = [], {}
    for i, (label, text) in enumerate(licenses.NOTICES):
        if not label.endswith("-text"):
            continue
        words = re.sub("[][]", "", text).split()
        if change == "a word in twenty replaced":
            words = [f"other{k}" if k % 20 == 10 and not re.search("version|[23]", w) else w for k, w in enumerate(words)]
        if change == "cut in half":
            words = words[: len(words) // 2]
        rows.append((i, " ".join(["Some", "prose", "before."] + words + ["and", "after."])))
        want[i] = label
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        own = [x for x in r.labels.split(",") if x.endswith("-text")]
        assert own == ([] if change == "cut in half" else [want[r.doc_id]])


def test_a_row_repeated_very_often(spark):
    one = spark.createDataFrame([(1, "cc by"), (2, "x")], "doc_id long, text string")
    many = one.unionByName(one.where("doc_id = 1").crossJoin(spark.range(25_000)).select("doc_id", "text"))
    out = licenses.scan(many).groupBy("doc_id", "n_base").count().collect()
    assert sorted(map(tuple, out)) == [(1, 1, 25_001), (2, 0, 1)]
