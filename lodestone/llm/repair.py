"""Conversation structure repair: the cheapest edits that give each conversation its proper sequence of roles.

The edits of a conversation are a path through the lattice of (turn index, state of the grammar), which is never built:
Dijkstra's search makes the moves of a node when it is popped, by (cost, audit), and stops at the first accepting end node.
Two paths of one cost to one node never have audits of which one begins the other, as inserts cost something; so the order
by (cost, audit) is kept by whatever follows, and stretches can be solved apart and joined.

That is how a conversation of any length is split. Its rows stand in a table sorted by range, of which tasks cut pieces of
``PIECE`` rows at most: one character a row, no text. Conversations that lie within one piece are solved there. Of the
others each piece is searched from every state, and Dijkstra's search over such stretches joins ``JOINED`` at a time, round
after round. Texts are shuffled once, to where their conversation's edits are; only there one task reads a whole
conversation, row by row, since its hash can't be had otherwise. It holds the edits and one batch of rows.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import again, as_key, from_key, stash, table

#: Rows of a piece; stretches that are joined at once.
PIECE, JOINED = 1024, 8
#: Costs of the edits, and of leaving a truncated row in.
KEEP, INSERT, REROLE, DELETE, TRUNCATED = 0, 3, 3, 4, 3
SPACE = " \t\n\x0b\x0c\r"
#: The grammar ``(s?(ua)+)?``: where a role's initial leads from each state, and the states that may end a conversation.
NEXT, ACCEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: A row is a character: a small letter as it is, a capital if truncated, a digit if it has to go. ``o`` is any other initial.
INITIALS, DEAD = "suao", "0123"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the rows, damaged by crc32 of ``conv_id:turn`` modulo 20; nulls there are one space."""
    told = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    damaged = rows.withColumn("kind", kind).where("kind <> 0")
    return damaged.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def cheapest(start, moves, ends, every: bool = False) -> dict:
    """Dijkstra's search by (cost, audit): the first of ``ends`` that is popped, or every one that can be reached."""
    queue, done, found = [(0, "", start)], set(), {}
    while queue:
        cost, audit, node = heappop(queue)
        if node in done:
            continue
        done.add(node)
        if node in ends:
            found[node] = (cost, audit)
            if not every or len(found) == len(ends):
                break
        for more, edits, to in moves(node):
            if to not in done:
                heappush(queue, (cost + more, audit + edits, to))
    return found


def edits_of(codes: str):
    """The moves of the lattice over ``codes``."""

    def moves(node):
        i, state = node
        for role in ROLES:
            if role in NEXT[state]:
                yield INSERT, "I", (i, NEXT[state][role])
        if i == len(codes):
            return
        yield DELETE, "D", (i + 1, state)
        code = codes[i]
        if code in DEAD:
            return
        extra = TRUNCATED if code.isupper() else 0
        if code.lower() in NEXT[state]:
            yield KEEP + extra, "K", (i + 1, NEXT[state][code.lower()])
        for role in ROLES:
            if role in NEXT[state]:
                yield REROLE + extra, "R", (i + 1, NEXT[state][role])

    return moves


def illegal(codes: str) -> int:
    """Adjacent rows whose initials may not follow each other."""
    initials = [INITIALS[DEAD.index(c)] if c in DEAD else c.lower() for c in codes]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def solve(codes: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return next(iter(cheapest((0, 0), edits_of(codes), [(len(codes), s) for s in ACCEPT]).values()))


_PATHS = "array<struct<entry: int, exit: int, cost: long, audit: string>>"
_PIECES = f"key string, at long, whole boolean, head string, tail string, illegal long, cost long, audit string, paths {_PATHS}"


def stretch(codes: str) -> list[tuple]:
    """(entry, exit, cost, audit) between all states that ``codes`` can lead from and to."""
    ends = [(len(codes), s) for s in range(len(NEXT))]
    return [(s, to, *best) for s in range(len(NEXT)) for (_, to), best in cheapest((0, s), edits_of(codes), ends, every=True).items()]


def _pieces(size: int):
    """Pieces of a sorted task's rows. The first and last conversation of a task may go on in another, so they aren't whole."""

    def told(key, at, codes, whole, known={}):  # noqa: B006  conversations of one pattern are solved once a worker
        head, tail = codes[0], codes[-1]
        if not whole:
            return (key, at, False, head, tail, illegal(codes), None, None, stretch(codes))
        if codes not in known:
            if len(known) > 100_000 or len(codes) > 64:
                known.clear()
            known[codes] = (illegal(codes), *solve(codes))
        return (key, at, True, head, tail, *known[codes], None)

    def run(batches):
        at, key, codes, inner, cut, out = TaskContext.get().partitionId() << 33, None, "", False, False, []
        begun = False
        for pdf in batches:
            keys, letters = pdf["key"], "".join(pdf["code"])
            starts = np.nonzero((keys.fillna("") != keys.shift().fillna("")) | (keys.isna() != keys.shift().isna()))[0]
            starts = np.unique(np.append(starts, 0))
            for a, b in zip(starts, [*starts[1:], len(pdf)]):
                mine = None if pd.isna(keys.iloc[a]) else keys.iloc[a]
                if begun and mine != key:
                    if codes:
                        out.append(told(key, at, codes, inner and not cut))
                        at += 1
                    codes, inner, cut = "", True, False
                key, begun = mine, True
                codes += letters[a:b]
                while len(codes) > size:
                    out.append(told(key, at, codes[:size], False))
                    codes, cut, at = codes[size:], True, at + 1
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _PIECES.split(", ", 8)])
                out = []
        if codes:
            yield pd.DataFrame([told(key, at, codes, False)], columns=[c.split()[0] for c in _PIECES.split(", ", 8)])

    return run


def _join(pdf: pd.DataFrame) -> pd.DataFrame:
    """A few adjacent stretches as one: Dijkstra's search again, a move being a whole stretch."""
    pdf = pdf.sort_values("at")
    ways = []
    for paths in pdf["paths"]:
        ways.append({})
        for p in paths:
            ways[-1].setdefault(p["entry"], []).append((p["cost"], p["audit"], p["exit"]))

    def moves(node):
        i, state = node
        if i < len(ways):
            for cost, audit, to in ways[i].get(state, ()):
                yield cost, audit, (i + 1, to)

    ends = [(len(ways), s) for s in range(len(NEXT))]
    paths = [(s, to, *best) for s in range(len(NEXT)) for (_, to), best in cheapest((0, s), moves, ends, every=True).items()]
    wrong = int(pdf["illegal"].sum()) + sum(illegal(a + b) for a, b in zip(pdf["tail"], pdf["head"].iloc[1:]))
    row = (pdf["key"].iloc[0], pdf["part"].iloc[0], False, pdf["head"].iloc[0], pdf["tail"].iloc[-1], wrong, None, None, paths)
    return pd.DataFrame([row], columns=[c.split()[0] for c in _PIECES.split(", ", 8)])


def _chosen():
    """(cost, audit) of what leads from the first state to an accepting one."""
    ends = F.filter("paths", lambda p: (p["entry"] == 0) & p["exit"].isin(*ACCEPT))
    return F.array_min(F.transform(ends, lambda p: F.struct(p["cost"], p["audit"])))


def facts(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(key, turn, role, digest, code, n, first) of rows that are alike; ``first``: no row before them has their role and text.

    Null roles and texts are one space. Copies are counted before they are shuffled, and no text is.
    """
    role, text = F.coalesce(rows["role"], F.lit(" ")), F.coalesce(rows["text"], F.lit(" "))
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    pick = lambda letters: F.substr(F.lit(letters), F.col("kind") + 1, F.lit(1))
    code = F.when(F.length("end") == 0, pick(DEAD)).when(F.substring("end", -1, 1).isin(".", "!", "?"), pick(INITIALS)).otherwise(pick(INITIALS.upper()))
    seen = rows.select(as_key(id_col).alias("key"), "turn", role.alias("role"), text.alias("text"))
    seen = seen.select("key", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), kind.alias("kind"), end.alias("end"))
    alike = seen.groupBy("key", "turn", "role", "digest").agg(F.min(code).alias("code"), F.min(pick(DEAD)).alias("dead"), F.count(F.lit(1)).alias("n"))
    begin = F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("begin")
    begins = alike.groupBy("key", "role", "digest").agg(begin).select(F.col("key").alias("k"), F.col("begin.turn").alias("t"), F.col("role").alias("r"), F.col("digest").alias("d"))
    same = F.col("key").eqNullSafe(F.col("k")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return alike.join(begins, same, "left").select("key", "turn", "role", "digest", "code", "dead", "n", F.col("d").isNotNull().alias("first"))


def repairs(rows: DataFrame, id_col: str = "conv_id", piece: int = PIECE, joined: int = JOINED) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows.

    Rows are taken by turn (nulls first), then by role, then by SHA-256 of the text. A null id is a conversation like others;
    ``key`` is the id as text. A role may be any text; it counts by its first character.
    """
    known = stash(facts(rows, id_col), "facts")
    blank, cut = F.col("code") == F.col("dead"), F.col("code").isin(*INITIALS.upper())
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    none = F.lit(0).cast("long")
    counted = known.groupBy("key").agg(
        gaps.alias("gaps"), F.sum(F.when(blank, F.col("n")).otherwise(none)).alias("blank"),
        F.sum(F.when(blank, none).otherwise(F.col("n") - F.col("first").cast("long"))).alias("duplicate"), F.count_if(cut & F.col("first")).alias("truncated"),
    )
    # the first of rows that are alike, then the others, which have to go
    own = F.struct(F.lit(0).alias("later"), F.when(F.col("first"), F.col("code")).otherwise(F.col("dead")).alias("code"), F.lit(1).cast("long").alias("n"))
    rest = F.struct(F.lit(1).alias("later"), F.col("dead").alias("code"), (F.col("n") - 1).alias("n"))
    by = ["key", "turn", "role", "digest", "later"]
    lines = known.select("key", "turn", "role", "digest", F.explode(F.array(own, rest)).alias("x")).select("key", "turn", "role", "digest", "x.*").where("n > 0")
    in_order = lines.repartitionByRange(*by).sortWithinPartitions(*by)
    pieces = stash(again(in_order, "n").select("key", "code").mapInPandas(_pieces(piece), _PIECES), "pieces")
    parts = pieces.where("not whole").drop("whole")
    while (parts.groupBy("key").count().agg(F.max("count")).first()[0] or 0) > 1:
        rank = F.row_number().over(Window.partitionBy("key").orderBy("at")) - 1
        grouped = parts.withColumn("part", F.floor(rank / joined)).groupBy("key", "part")
        parts = stash(grouped.applyInPandas(_join, _PIECES), "parts").drop("whole")
    long = parts.withColumn("best", _chosen()).select("key", "illegal", "best.cost", "best.audit")
    solved = pieces.where("whole").select("key", "illegal", "cost", "audit").unionByName(long)
    return counted.withColumnRenamed("key", "k").join(solved, F.col("k").eqNullSafe(F.col("key"))).select("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


_TOLD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _walked(batches):
    """Follows each conversation's audit along its rows: ("begin", its row of sums), then (edit, role, text) of what is left, then ("end", that row)."""
    told, audit, at, state = None, "", 0, 0

    def inserts():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = "u" if "u" in NEXT[state] else "a"
            at, state = at + 1, NEXT[state][role]
            yield "I", ROLES[role], ""

    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if not row.kind:
                if told is not None:
                    yield from inserts()
                    yield "end", told, None
                told, audit, at, state = row, row.text, 0, 0
                yield "begin", told, None
                continue
            yield from inserts()
            edit, role = audit[at], row.role
            at += 1
            if edit == "D":
                continue
            if edit == "R":
                role = ROLES["u" if "u" in NEXT[state] else "a"]
            state = NEXT[state][role[0]]
            yield edit, role, row.text
    if told is not None:
        yield from inserts()
        yield "end", told, None


#: Rows, and characters of their texts, that leave at once.
AT_ONCE, CHARACTERS = 10_000, 8 << 20


def _rows(batches):
    out, size, place, key = [], 0, 0, None
    for edit, role, text in _walked(batches):
        if edit in ("begin", "end"):
            place, key = 0, role.key
            continue
        out.append((key, place, edit, role, text))
        place, size = place + 1, size + len(text)
        if len(out) >= AT_ONCE or size >= CHARACTERS:
            yield pd.DataFrame(out, columns=["key", "place", "edit", "role", "text"])
            out, size = [], 0
    if out:
        yield pd.DataFrame(out, columns=["key", "place", "edit", "role", "text"])


def _digests(batches):
    out, digest, lines = [], None, 0
    for edit, role, text in _walked(batches):
        if edit == "begin":
            digest, lines = hashlib.sha256(), 0
        elif edit == "end":
            out.append((role.key, *(getattr(role, c) for c in _TOLD), role.text, digest.hexdigest()))
            if len(out) >= AT_ONCE:
                yield pd.DataFrame(out, columns=["key", *_TOLD, "audit", "repaired_sha256"])
                out = []
        else:
            digest.update(f"{'\n' if lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            lines += 1
    if out:
        yield pd.DataFrame(out, columns=["key", *_TOLD, "audit", "repaired_sha256"])


def _together(rows: DataFrame, plans: DataFrame, id_col: str) -> DataFrame:
    """Each conversation's sums and audit (kind 0), then its rows in order (kind 1), next to each other in one task."""
    none = F.lit(None)
    heads = plans.select("key", F.lit(0).alias("kind"), none.cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), *_TOLD)
    texts = rows.select(as_key(id_col), F.lit(1).alias("kind"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), *[none.cast("long").alias(c) for c in _TOLD])
    dealt = heads.unionByName(texts).repartition("key").withColumn("digest", F.unhex(F.sha2("text", 256)))
    return dealt.sortWithinPartitions("key", "kind", "turn", "role", "digest").select("key", "kind", "role", "text", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _TOLD])


def repaired(rows: DataFrame, plans: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, place, edit, role, text): the conversations as ``plans`` (of ``repairs``) leave them; edit is K, R or I."""
    return from_key(_together(rows, plans, id_col).mapInPandas(_rows, "key string, place long, edit string, role string, text string"), rows, id_col)


def digests(rows: DataFrame, plans: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``plans`` with repaired_sha256: of ``role:text`` of what ``repaired`` returns, joined by newlines."""
    sums = ", ".join(f"{c} long" for c in _TOLD)
    return from_key(_together(rows, plans, id_col).mapInPandas(_digests, f"key string, {sums}, audit string, repaired_sha256 string"), rows, id_col)


def repair(rows: DataFrame, whole: DataFrame | None = None, id_col: str = "conv_id") -> DataFrame:
    """One row for each conversation of ``whole`` (``rows``): id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    One without rows has zeros, an empty audit and the hash of the empty text. Null ids are one conversation; null roles and
    texts are one space; null turns come first and don't count as gaps; other columns are not read.
    """
    found = repairs(rows, id_col)
    names = (rows if whole is None else whole).select(as_key(id_col)).distinct().withColumnRenamed("key", "k")
    plans = names.join(found, F.col("k").eqNullSafe(F.col("key")), "left").drop("key").withColumnRenamed("k", "key")
    plans = stash(plans.fillna(0, list(_TOLD)).fillna("", ["audit"]), "plans")
    return digests(rows, plans, id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair(damage(rows), rows)


ORACLE_SQL = """
WITH RECURSIVE told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS named FROM conversations),
hashed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(named) + 1), lambda i: ord(substr(named, i::INTEGER, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))) % 20 AS kind FROM told),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS time
  FROM hashed WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), time) AS i, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS body FROM damaged),
judged AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
counted AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
    count_if(i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
follows(state, initial, role, next) AS (VALUES (0, 's', NULL, 1), (0, 'u', 'user', 2), (1, 'u', 'user', 2), (2, 'a', 'assistant', 3), (3, 'u', 'user', 2)),
inserts(state, next, audit, lines) AS (
  SELECT state, state, '', []::VARCHAR[] FROM range(4) t(state)
  UNION ALL SELECT state, next, 'I', [role || ':'] FROM follows WHERE role IS NOT NULL
  UNION ALL SELECT a.state, b.next, 'II', [a.role || ':', b.role || ':'] FROM follows a JOIN follows b ON a.next = b.state WHERE a.role IS NOT NULL AND b.role IS NOT NULL AND b.next <> a.state),
moves AS (
  SELECT conv_id, i, s.state, s.state AS next, 4 AS cost, 'D' AS edit, NULL AS line FROM judged, range(4) s(state)
  UNION ALL SELECT conv_id, i, state, next, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', j.role || ':' || text FROM judged j JOIN follows f USING (initial) WHERE fault NOT IN ('blank', 'duplicate')
  UNION ALL SELECT conv_id, i, state, next, 3 + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'R', f.role || ':' || text FROM judged j, follows f WHERE f.role IS NOT NULL AND fault NOT IN ('blank', 'duplicate')),
walk(conv_id, i, state, best) AS (
  SELECT conv_id, 0::BIGINT, next, {'cost': 3 * length(audit), 'audit': audit, 'lines': lines} FROM counted, inserts WHERE state = 0
  UNION ALL
  SELECT w.conv_id, m.i, n.next, min({'cost': w.best.cost + m.cost + 3 * length(n.audit), 'audit': w.best.audit || m.edit || n.audit,
    'lines': list_concat(w.best.lines, CASE WHEN m.line IS NULL THEN [] ELSE [m.line] END, n.lines)})
  FROM walk w JOIN moves m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1 AND m.state = w.state JOIN inserts n ON n.state = m.next
  GROUP BY w.conv_id, m.i, n.next),
solved AS (
  SELECT c.conv_id, min(w.best) AS best FROM counted c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n WHERE w.state IN (0, 3) GROUP BY c.conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
"""
