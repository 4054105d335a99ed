"""Conversation repair against a layered search over every path, and its odd cases."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import repair

ROWS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, text) of rows in order: every state's best path, layer by layer."""
    faults, seen = [], set()
    for role, text in rows:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def inserted(layer):
        for _ in range(3):
            for state, (cost, audit, lines) in list(layer.items()):
                for role in ("user", "assistant"):
                    if (to := step[state].get(role[0])) and (cost + 3, audit + "I") < layer.get(to, (10**9,))[:2]:
                        layer[to] = (cost + 3, audit + "I", [*lines, f"{role}:"])
        return layer

    layer = inserted({"": (0, "", [])})
    for (role, text), fault in zip(rows, faults):
        after = {}

        def offer(to, *way):
            if to is not None and (to not in after or way[:2] < after[to][:2]):
                after[to] = way

        for state, (cost, audit, lines) in layer.items():
            offer(state, cost + 4, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 * (fault == "truncated")
            offer(step[state].get(role[:1]), cost + extra, audit + "K", [*lines, f"{role}:{text}"])
            for new in ("user", "assistant"):
                offer(step[state].get(new[0]), cost + extra + 3, audit + "R", [*lines, f"{new}:{text}"])
        layer = inserted(after)
    cost, audit, lines = min(layer[s] for s in ("", "a") if s in layer)
    initials = [r[:1] for r, _ in rows]
    return (*(faults.count(x) for x in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, "\n".join(lines))


def in_order(rows):
    """(role, text) by turn, nulls first, then by role and hash of the text, as the operator says."""
    told = [(turn, role if role is not None else " ", text if text is not None else " ") for turn, role, text in rows]
    return [(r, t) for _, r, t in sorted(told, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()))]


def check(spark, rows, piece, joined, tasks=5):
    df = spark.createDataFrame(rows, ROWS).withColumn("key", F.lit("clash")).withColumn("code", F.lit(1)).repartition(tasks)
    whole = repair.repairs(df, piece=piece, joined=joined)
    got = {r.conv_id: r for r in repair.digests(df, whole).collect()}
    by = {}
    for conv, *row in rows:
        by.setdefault(conv, []).append(row)
    assert set(got) == set(by)
    for conv, mine in by.items():
        want, r = brute(in_order(mine)), got[conv]
        turns = {t for t, *_ in mine if t is not None}
        assert r.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        assert (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == want[:6]
        assert r.repaired_sha256 == hashlib.sha256(want[6].encode()).hexdigest()
    return df, whole


def test_every_short_conversation():
    codes = [*repair.INITIALS, *repair.INITIALS.upper(), *repair.DEAD]
    role = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for n in range(4):
        for some in itertools.product(codes, repeat=n):
            rows = []
            for i, c in enumerate(some):
                initial = repair.INITIALS[repair.DEAD.index(c)] if c in repair.DEAD else c.lower()
                rows.append((role[initial], "" if c in repair.DEAD else f"text {i}" if c.isupper() else f"text {i}."))
            _, _, _, illegal, cost, audit, _ = brute(rows)
            assert (repair.illegal("".join(some)), *repair.solve("".join(some))) == (illegal, cost, audit)


def test_stretches_join_to_the_whole():
    deal = random.Random(1)
    for _ in range(200):
        codes = "".join(deal.choices("suaoSUA0123", [1, 6, 6, 1, 1, 2, 2, 1, 1, 1, 1], k=deal.randint(0, 24)))
        ends = [(len(codes), s) for s in repair.ACCEPT]
        paths = {}
        for i in range(0, len(codes), 5):
            for entry, to, cost, audit in repair.stretch(codes[i : i + 5]):
                paths.setdefault((i, entry), []).append((cost, audit, (min(i + 5, len(codes)), to)))
        if codes:
            assert min(repair.cheapest((0, 0), lambda n: paths.get(n, ()), ends).values()) == repair.solve(codes)


@pytest.mark.parametrize(("piece", "joined"), [(1024, 8), (3, 2)])
def test_odd_conversations(spark, piece, joined):
    deal = random.Random(piece)
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Ho."), (1, 1, "assistant", "Ho."), (2, None, None, None), (2, None, "user", "Late?"), (2, 5, "", "No role."), (3, 0, None, ""), (3, 0, None, ""),
        (None, 1, "user", "Whose?"), (None, 2, "assistant", "Mine"), (4, 9, "user", "x" * 300_000), (5, 0, "User", "Capital."), (6, 0, "ufo", "Initial u."), (7, -3, "system", "\x0b\x0c"), (8, 2, "a", " "),
        (9, None, "user", "One."), (9, None, "user", "One."), (9, None, "assistant", "Two."), (9, 4, "user", "One."),
    ]
    rows += [(10, i, deal.choice(["system", "user", "assistant", "tool", "user", "assistant"]), deal.choice(["Yes.", "No", "", "Why?", f"{i}.", f"{i}"])) for i in range(90)]
    rows += [(10, 3, "user", "Again.")] * 40 + [(None, None, "assistant", "Mine")] * 7
    rows += [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(20, 40) for t in range(6)]
    df, plans = check(spark, rows, piece, joined)
    left = repair.repaired(df, plans).where("conv_id is null").orderBy("place").collect()
    assert [(r.place, r.edit, r.role, r.text) for r in left] == [(i, e, r, t) for i, (e, r, t) in enumerate(_left(rows, None))]


def _left(rows, conv):
    mine = in_order([row for c, *row in rows if c == conv])
    *_, audit, text = brute(mine)
    edits, lines = [e for e in audit if e != "D"], text.split("\n")
    return [(e, *line.split(":", 1)) for e, line in zip(edits, lines)]


def test_damage_by_the_rule_and_conversations_without_rows(spark):
    rows = [(c, t, r, f"Text {c}, {t}. Fine?!") for c in range(60) for t, r in enumerate(["system", "user", "assistant"])] + [(None, None, None, None), (3, None, None, "Odd!")]
    df = spark.createDataFrame(rows, ROWS).withColumn("kind", F.lit("clash")).withColumn("time", F.lit("clash"))
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else x.translate({ord(y): None for y in ".!?"}) if kind == 2 else x
        want += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = [tuple(r) for r in repair.damage(df).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    out = {r.conv_id: r for r in repair.repair(repair.damage(df).where("conv_id <> 7 or conv_id is null"), df).collect()}
    assert set(out) == {r[0] for r in rows}
    assert tuple(out[7])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_table(spark):
    assert repair.repair(repair.damage(spark.createDataFrame([], ROWS))).count() == 0
