"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, stored as sorted hash arrays, memory-mapped by workers.

Counting: tasks count the n-grams of their texts and send them on as packed blobs, dealt by the hash of the last two words,
so that all that ends in two words comes together: a shard has the whole counts of its n-grams of every length, and how many
words each is found after. It writes their sorted hashes and counts to the shared folder and sends on what each context and
each word is owed (followers by count, predecessors, occurrences); a last pass adds that up and writes arrays beside those of
the n-grams. As every n-gram has both counts, a model scores with fewer words than its own too. Nothing is cut: the model
grows with the corpus. A text begins with as many marks as a context has words, so that every token has whole contexts; the
marks alone are kept as an n-gram that is no token's, as a context like any other.
Scoring: each worker maps the arrays and looks the distinct n-grams of a batch up by bisection; the pages it touches
are the only ones that come into memory.

The shared folder must be one that workers can open as files; of other stores, the shards that are used are copied once an
executor, into the folder that Spark gives it for files and removes when it ends.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import OrderedDict, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import as_key, crc_remainder, from_key, new_path, table

#: Tokens that a task counts, or n-grams that it holds, before it sends blobs on; shards for each input partition; tokens scored at once.
FLUSH, SHARDS_EACH, AT_ONCE = 2_500_000, 2, 1_000_000
#: Bits of shards that blobs are dealt to in one go, as more would make blobs of an n-gram each; files that a worker holds open.
GO, MAPS = 17, 32
#: Words of an n-gram, where none is asked for; those of the query's model, which scores with ``ORDER`` words beside.
ORDER, MOST = 2, 3
#: Names of the marks that stand before and after a text; no token holds white space.
BEGIN, END = b" begin", b" end"
KEEP = 7  # bytes of a word's hash: 56 bits tell apart all words of any corpus but a few in a billion
MASK = (1 << (8 * KEEP)) - 1
#: Bits of an n-gram's hash that are told apart within a shard, and n-grams for each entry of a shard's directory.
WITHIN, BUCKET = 48, 16


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) & MASK


def _numbers() -> defaultdict:
    """Gives each new word the next number; the marks before and after a text have the first two."""
    known = defaultdict()
    known.default_factory = known.__len__
    known.update({BEGIN: 0, END: 1})
    return known


def _hashes(known) -> np.ndarray:
    return np.fromiter(map(word_hash, known), np.uint64, len(known))


def pair_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = context * np.uint64(0x9E3779B97F4A7C15)
        h ^= word + np.uint64(0x7F4A7C15)
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        return h


def gram_hash(words: np.ndarray, names: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the n-grams in the columns of ``words`` (two rows at least, the first word first), which may be places in ``names``."""
    of = (lambda x: x) if names is None else (lambda x: names[x])
    context = of(words[-2])
    for older in words[-3::-1]:
        context = pair_hash(context, of(older)) & np.uint64(MASK)
    return pair_hash(context, of(words[-1]))


def gram_key(words: np.ndarray, bits: int) -> np.ndarray:
    """The same, with the shard in the first bits: that of the last two words, whatever the length."""
    h = gram_hash(words)
    if len(words) == 2 or not bits:
        return h
    rest = np.uint64(64 - bits)
    return (gram_hash(words[-2:]) >> rest << rest) | (h >> np.uint64(bits))


def windows(ids: np.ndarray, order: int) -> np.ndarray:
    """(order, n): what stands before and at each of ``ids``, which itself is the last row."""
    out = np.zeros((order, len(ids)), ids.dtype)
    for k in range(order):
        out[order - 1 - k, k:] = ids[: max(0, len(ids) - k)]
    return out


def tokens_of(text) -> list[bytes]:
    """The tokens of a text (null: none): A-Z lower-cased, split at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers, byte by byte of equal rank, as few as the largest needs."""
    values = np.ascontiguousarray(values, "<u8")
    wide = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + values.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = data[0]
    out = np.zeros(((len(data) - 1) // wide, 8), np.uint8)
    out[:, :wide] = np.frombuffer(data, np.uint8, offset=1).reshape(wide, -1).T
    return out.view("<u8").ravel()


def _pack_counts(counts: np.ndarray) -> bytes:
    """One byte each; 255 stands for a larger one, which follows after all."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<u8").tobytes()


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.uint64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n)
    return out


def _bundle(*arrays: np.ndarray) -> bytes:
    """Several arrays packed and compressed as one."""
    parts = [_pack(x) for x in arrays]
    data = b"".join([np.array([len(parts), *map(len, parts)], "<u8").tobytes(), *parts])
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unbundle(data: bytes) -> list[np.ndarray]:
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    k = int.from_bytes(data[:8], "little")
    ends = 8 + 8 * k + np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u8", k, 8).astype(np.int64))])
    return [_unpack(data[a:b]) for a, b in zip(ends, ends[1:])]


def _steps(ordered: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences; ``np.cumsum`` of them gives the numbers back."""
    return np.diff(ordered, prepend=ordered.dtype.type(0))


def _shard(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def _cut(shards: np.ndarray):
    """(shard, from, to) of runs of equal sorted shards."""
    starts = np.concatenate([[0], np.nonzero(np.diff(shards))[0] + 1])
    return [(int(shards[a]), a, b) for a, b in zip(starts, [*starts[1:], len(shards)])] if len(shards) else []


def _starts(h: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted hashes start."""
    return np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0] if len(h) else np.zeros(0, np.int64)


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


BLOBS = "shard int, times binary, grams binary"


def _blobs(words: np.ndarray, counts: np.ndarray, bits: int) -> pd.DataFrame:
    """Counted n-grams (order, n), packed by shard: each blob has the hashes of its words once, the frequent ones first, as differences."""
    shard = _shard(gram_hash(words[-2:]), bits)
    at = np.argsort(shard, kind="stable")
    words, counts, shard = words[:, at], counts[at], shard[at]
    rows = []
    for s, a, b in _cut(shard):
        names, ids, times = np.unique(words[:, a:b], return_inverse=True, return_counts=True)
        by = np.argsort(-np.frexp(times)[1], kind="stable")  # by the number of bits of the times, then by hash
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(len(by), dtype=np.int32)
        ids = rank[ids.reshape(len(words), b - a)]
        at = np.lexsort((ids[-1], ids[-2]))
        ids, n = ids[:, at], counts[a:b][at]
        before, last = _steps(ids[-2]), ids[-1].copy()
        same = np.nonzero(before[1:] == 0)[0] + 1
        last[same] -= ids[-1][same - 1]
        rows.append((s, _pack_counts(n), _bundle(_steps(names[by]) & np.uint64(MASK), before, last, *ids[:-2])))
    return pd.DataFrame(rows, columns=_names(BLOBS))


def _unblob(times: bytes, grams: bytes) -> tuple[np.ndarray, np.ndarray]:
    names, before, last, *older = _unbundle(grams)
    names = np.cumsum(names) & np.uint64(MASK)
    starts = np.nonzero(np.concatenate([[True], before[1:] > 0]))[0]
    sums = np.cumsum(last)
    last = sums - np.repeat(sums[starts] - last[starts], np.diff([*starts, len(last)]))
    return names[np.stack([*older, np.cumsum(before), last]).astype(np.int64)], _unpack_counts(times, len(last))


def _join(parts):
    """The (words, counts) of many blobs as one."""
    return tuple(np.concatenate(x, axis=-1) for x in zip(*parts))


def _deal(bits: int, most: int):
    """Blobs of a few shards, which come together, as blobs of the many that these are cut into; never a whole group at once."""

    def run(batches):
        held, size = [], 0
        for pdf in batches:
            for blob in pdf[_names(BLOBS)[1:]].itertuples(index=False):
                held.append(_unblob(*blob))
                size += len(held[-1][1])
                if size >= most:
                    yield _blobs(*_join(held), bits)
                    held, size = [], 0
        if held:
            yield _blobs(*_join(held), bits)

    return run


def _count(order: int, bits: int):
    def send(ids: list, known: dict, texts: int):
        at, names = np.array(ids, np.int32), _hashes(known)
        ids.clear(), known.clear()
        words = windows(at, order)[:, at > 0]
        _, at, counts = np.unique(gram_hash(words, names), return_index=True, return_counts=True)
        words = np.concatenate([words[:, at], np.zeros((order, 1), np.int32)], axis=1)  # the marks alone, once a text
        return _blobs(names[words], np.append(counts, texts), bits)

    def run(batches):
        known, ids, texts = _numbers(), [], 0
        for pdf in batches:
            for text in pdf["text"]:
                ids.extend([0] * (order - 1)), ids.extend(map(known.__getitem__, tokens_of(text))), ids.append(1)
                texts += 1
                if len(ids) >= FLUSH:
                    yield send(ids, known, texts)
                    known, ids, texts = _numbers(), [], 0
        if ids:
            yield send(ids, known, texts)

    return run


#: Arrays of a file, in this order, after the bytes of each: sorted hashes by a directory of their first bits and the 32 next
#: ones, and a row of numbers for each, as the place in a table of the most frequent rows, or 255 for one in ``rest``.
COLUMNS = {"table": np.uint64, "rest": np.uint64, "directory": np.uint32, "low": np.uint32, "places": np.uint32, "code": np.uint8}


def _sorted_hashes(within: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted hashes of ``WITHIN`` bits, as they are stored."""
    k = min(WITHIN - 32, (len(within) // BUCKET).bit_length())
    ends = np.searchsorted(within >> np.uint64(WITHIN - k), np.arange((1 << k) + 1, dtype=np.uint64))
    return {"directory": ends, "low": within >> np.uint64(WITHIN - 32 - k) & np.uint64(0xFFFFFFFF)}


def _rows(*columns: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of numbers, as they are stored."""
    each, wide = 63 // len(columns), np.stack(columns).astype(np.uint64)
    small, packed = np.nonzero((wide < np.uint64(1 << each)).all(axis=0))[0], np.zeros(wide.shape[1], np.uint64)
    for x in wide:
        packed = packed << np.uint64(each) | x
    _, first, at, times = np.unique(packed[small], return_index=True, return_inverse=True, return_counts=True)
    best = np.argsort(-times, kind="stable")[:255]
    codes = np.full(len(times), 255, np.uint8)
    codes[best] = np.arange(len(best))
    code = np.full(wide.shape[1], 255, np.uint8)
    code[small] = codes[at]
    places = np.nonzero(code == 255)[0]
    return {"table": wide[:, small[first[best]]].T.ravel(), "rest": wide[:, places].T.ravel(), "places": places, "code": code}


def _store(where: str, group: str, shard: int, **arrays: np.ndarray) -> None:
    """Writes the arrays of a shard to its file; a repeated task replaces what an earlier one wrote."""
    store, root = fs.FileSystem.from_uri(where)
    own = [np.ascontiguousarray(arrays.get(c, ()), kind) for c, kind in COLUMNS.items()]
    part = f"{root}/{group}-{shard:05d}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as f:
        f.write(np.array([x.nbytes for x in own], np.uint64).tobytes())
        for x in own:
            f.write(x.tobytes())
    store.move(part, f"{root}/{group}-{shard:05d}")


def _within(key: np.ndarray, bits: int) -> np.ndarray:
    return key << np.uint64(bits) >> np.uint64(64 - WITHIN)


#: What a context or a word is owed: ``part`` is minus one and less for counts of counts, 1 for words, else the length of the contexts.
OWED = "part long, slot int, data binary"


def _kinds(own: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Followers seen once, twice, more often, of each of ``len(own)``; ``counts`` are (place, count)."""
    at, c = counts
    return [np.bincount(at, m, len(own)).astype(np.uint64) for m in (c == 1, c == 2, c >= 3)]


def _of_contexts(context: np.ndarray, main: np.ndarray, raw: np.ndarray, top: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """What contexts are owed by their followers, the top ones of which have one kind of counts."""
    own, at = np.unique(context, return_inverse=True)
    if top:
        return own, _kinds(own, at, raw)
    return own, [*_kinds(own, at, main), np.bincount(at, main, len(own)).astype(np.uint64), *_kinds(own, at, raw)]


def _of_longer_contexts(context: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The same of top followers whose contexts are n-grams, and all that these followers were seen.

    A context is stored with how often it was seen, which is what all its followers were: those that no shard tells of were
    seen once each. So a shard is silent about contexts of which it has such followers only, as nearly all are.
    """
    own = np.unique(context[raw > 1])
    at = np.minimum(np.searchsorted(own, context), max(0, len(own) - 1))
    told = own[at] == context if len(own) else np.zeros(len(context), bool)
    at, raw = at[told], raw[told]
    return own, [*_kinds(own, at, raw), np.bincount(at, raw, len(own)).astype(np.uint64)]


def _counted(part: int, counts: np.ndarray) -> tuple:
    return part, 0, _bundle(np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5])


def _owe(part: int, key: np.ndarray, columns: list[np.ndarray], bits: int, go: int) -> list[tuple]:
    """Rows of ``OWED``, by slot: sorted keys of ``bits`` of shard, without what the slot says and no lookup needs."""
    slot, rest = _shard(key, min(bits, go)), key << np.uint64(min(bits, go))
    rest = rest >> np.uint64(64 - WITHIN) if bits <= go else rest
    return [(part, s, _bundle(_steps(rest[a:b]), *[c[a:b] for c in columns])) for s, a, b in _cut(slot)]


def _sum_owed(data) -> tuple[np.ndarray, list[np.ndarray]]:
    """(keys, summed columns) of such rows of a slot."""
    rows = [_unbundle(x) for x in data]
    key, at = np.unique(np.concatenate([np.cumsum(x[0]) for x in rows]), return_inverse=True)
    return key, [np.bincount(at, np.concatenate(c), len(key)).astype(np.uint64) for c in zip(*[x[1:] for x in rows])]


def _add_grams(where: str, order: int, bits: int, word_bits: int, go: int):
    """Adds the blobs of a shard up, stores its n-grams of each length, and sends on counts of counts and what contexts and words are owed."""
    begin = word_hash(BEGIN)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["shard"].iloc[0])
        words, n = _join(_unblob(*blob) for blob in pdf[_names(BLOBS)[1:]].itertuples(index=False))
        rows = []
        for level in range(order, 1, -1):
            key = gram_key(words, bits)
            at = np.argsort(key, kind="stable")
            first = _starts(key[at])
            main = np.diff([*first, len(key)]).astype(np.uint64)  # words that the n-gram is found after
            key, words, n = key[at][first], words[:, at[first]], np.add.reduceat(n[at], first)
            top = level == order
            _store(where, f"grams{level}", s, **_sorted_hashes(_within(key, bits)), **_rows(*((n,) if top else (main, n))))
            token = words[-1] != begin
            w, m, raw = words[:, token], main[token], n[token]
            rows += [_counted(-level, raw if top else m)] + ([] if top else [_counted(-level - MARK, raw)])
            if level > 2:
                context = gram_key(w[:-1], bits)
                rows += _owe(level - 1, *(_of_longer_contexts(context, raw) if top else _of_contexts(context, m, raw, top)), bits, go)
            else:  # the hash of a word has 56 bits
                own, columns = _of_contexts(w[0], m, raw, top)
                after, at = np.unique(w[1], return_inverse=True)
                both = np.unique(np.concatenate([own, after]))
                of, to = np.searchsorted(both, own), np.searchsorted(both, after)
                spread = lambda x, at: np.bincount(at, x, len(both)).astype(np.uint64)
                told = [spread(np.bincount(at, minlength=len(after)), to), spread(np.bincount(at, raw, len(after)), to), *[spread(c, of) for c in columns]]
                rows += _owe(1, both << np.uint64(8), told, word_bits, go)
            words = words[1:]
        return pd.DataFrame(rows, columns=_names(OWED))

    return run


#: Stands between the counts of counts of what n-grams are found after, and of how often they are found.
MARK = 1000


def _deal_owed(bits: int, word_bits: int, go: int, most: int):
    """What is owed in a few slots, which come together, summed and sent on to the many that these are cut into."""

    def run(batches):
        held, size, of = [], 0, None

        def told():
            part, slot = of
            own = word_bits if part == 1 else bits
            key, columns = _sum_owed(held)
            first = np.uint64(slot) << np.uint64(64 - go) if go else np.uint64(0)
            return pd.DataFrame(_owe(part, first | key >> np.uint64(go), columns, own, own), columns=_names(OWED))

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.part < 0 or (word_bits if row.part == 1 else bits) <= go:
                    yield pd.DataFrame([row], columns=_names(OWED))
                    continue
                if held and (of != (row.part, row.slot) or size >= most):
                    yield told()
                    held, size = [], 0
                of = row.part, row.slot
                held.append(row.data)
                size += len(row.data) // 4
        if held:
            yield told()

    return run


_SUMS = ["part", "tokens", "words", "types", "n1", "n2", "n3", "n4"]


def _add_owed(where: str):
    """Adds up what the contexts or words of a slot are owed, stores them, and sends on the sums."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part, s = int(pdf["part"].iloc[0]), int(pdf["slot"].iloc[0])
        if part < 0:
            return pd.DataFrame([(part, 0, 0, 0, *np.sum([_unbundle(x)[0] for x in pdf["data"]], axis=0).astype(np.int64).tolist())], columns=_SUMS)
        key, columns = _sum_owed(pdf["data"])
        _store(where, "words" if part == 1 else f"followers{part}", s, **_sorted_hashes(key), **_rows(*columns))
        if part > 1:
            return pd.DataFrame([], columns=_SUMS).astype("int64")
        before, n = columns[:2]
        seen = np.bincount(np.minimum(before, 5).astype(np.int64), minlength=6)[1:5].tolist()
        return pd.DataFrame([(1, int(n.sum()), int((n > 0).sum()), int(before.sum()), *seen)], columns=_SUMS)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from counts of counts; half the count where a small corpus gives none."""
    if min(n1, n2, n3) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k - 0.05) for x, k in zip(d, (1, 2, 3)))


@dataclass
class Model:
    """Where the arrays are, and the few sums of a model."""

    where: str
    bits: int
    word_bits: int = 0
    tokens: int = 0
    words: int = 0
    types: int = 0
    discounts: tuple = ()  # three for each number of words, from one
    beside: tuple = ()  # three for each number of words from two on, where it is the model's whole order; without its own
    unseen: float = 1.0  # mass that the word level leaves to all words alike


def _find(arrays: dict[str, np.ndarray], within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether it is there) of hashes among the sorted ones of a shard."""
    low, directory = arrays["low"], arrays["directory"]
    k = max(0, len(directory) - 1).bit_length() - 1
    if not len(low):
        return np.zeros(len(within), np.int64), np.zeros(len(within), bool)
    bucket, asked = (within >> np.uint64(WITHIN - k)).astype(np.int64), (within >> np.uint64(WITHIN - 32 - k) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    a, end = directory[bucket].astype(np.int64), directory[bucket + 1].astype(np.int64)
    b = end.copy()
    for _ in range(int((b - a).max(initial=0)).bit_length()):
        half = (a + b) >> 1
        less = (a < b) & (low[np.minimum(half, len(low) - 1)] < asked)
        a, b = np.where(less, half + 1, a), np.where(less, b, half)
    at = np.minimum(a, len(low) - 1)
    return at, (a < end) & (low[at] == asked)


def _row_at(arrays: dict[str, np.ndarray], at: np.ndarray, wide: int) -> np.ndarray:
    """The rows of numbers (n, wide) at the places."""
    code = arrays["code"][at]
    out, more = np.zeros((len(at), wide), np.int64), code == 255
    out[~more] = arrays["table"].reshape(-1, wide)[code[~more]]
    if more.any():
        out[more] = arrays["rest"].reshape(-1, wide)[np.searchsorted(arrays["places"], at[more])]
    return out


class Lookup:
    """The shards of a model, mapped when they are touched. Only the last ``MAPS`` stay open: mapping one again costs little."""

    def __init__(self, model: Model, maps: int = MAPS):
        self.model, self.maps, self.most = model, OrderedDict(), maps
        path = re.sub(r"^file:/+", "/", model.where)
        self.local = path if path.startswith("/") else None

    def shard(self, group: str, s: int) -> dict[str, np.ndarray]:
        """The arrays of a shard by name; empty ones where none was written."""
        name = f"{group}-{s:05d}"
        if name in self.maps:
            self.maps.move_to_end(name)
            return self.maps[name]
        path = f"{self.local}/{name}" if self.local else self.fetched(name)
        whole = np.memmap(path, np.uint8, "r") if os.path.exists(path) else np.zeros(8 * len(COLUMNS), np.uint8)
        at, out = 8 * len(COLUMNS), {}
        for (c, kind), n in zip(COLUMNS.items(), whole[:at].view(np.uint64).tolist()):
            out[c] = whole[at : at + n].view(kind)
            at += n
        self.maps[name] = out
        while len(self.maps) > self.most:
            self.maps.popitem(last=False)  # the file is closed with the last array that looks into it
        return out

    def fetched(self, name: str) -> str:
        store, root = fs.FileSystem.from_uri(self.model.where)
        own = f"{SparkFiles.getRootDirectory()}/{os.path.basename(root)}"
        os.makedirs(own, exist_ok=True)
        path = f"{own}/{name}"
        if not os.path.exists(path) and store.get_file_info(f"{root}/{name}").is_file:
            part = f"{path}.{uuid.uuid4().hex}"
            fs.copy_files(f"{root}/{name}", part, source_filesystem=store, destination_filesystem=fs.LocalFileSystem())
            os.replace(part, path)  # workers of one executor may copy at once; each file is whole
        return path

    def find(self, key: np.ndarray, bits: int, **groups: int) -> list[np.ndarray]:
        """Rows of numbers (n, wide) of keys in each of ``groups`` (name: wide); zero where it isn't stored."""
        key, back = np.unique(key, return_inverse=True)
        out, within = [np.zeros((len(key), wide), np.int64) for wide in groups.values()], _within(key, bits)
        for s, a, b in _cut(_shard(key, bits)):
            for x, (group, wide) in zip(out, groups.items()):
                arrays = self.shard(group, s)
                at, hit = _find(arrays, within[a:b])
                if hit.any():
                    x[a + np.nonzero(hit)[0]] = _row_at(arrays, at[hit], wide)
        return [x[back] for x in out]

    def score(self, texts: list, further: tuple[int, ...] = ()) -> pd.DataFrame:
        """n_tokens, n_known, base_score and score of each text, and score_<k> for each k of ``further``, fewer words than the model's."""
        m = self.model
        order = len(m.discounts)
        known, ids, sizes = _numbers(), [], []
        for text in texts:
            mine = tokens_of(text)
            ids.extend([0] * (order - 1)), ids.extend(map(known.__getitem__, mine)), ids.append(1)
            sizes.append(len(mine) + 1)
        ids, hashes = np.array(ids, np.int64), _hashes(known)
        words = windows(hashes[ids], order)
        token = np.nonzero(ids > 0)[0]
        _, place, back = np.unique(gram_hash(words[:, token]), return_index=True, return_inverse=True)
        at = token[place]  # the distinct n-grams: at these tokens
        (about,) = self.find(hashes << np.uint64(8), m.word_bits, words=5 if order == 2 else 9)
        before, n = about[:, 0], about[:, 1]
        total_of = n.copy()
        total_of[0] = n[1]  # as many begin as end
        # word level: discounted predecessors, and the rest shared by all words and the unknown one
        cut = np.array([0, *m.discounts[0]])[np.minimum(before, 3)]
        low = (np.maximum(before - cut, 0) / max(1, m.types)) + m.unseen / (m.words + 1)
        p, found = low[ids[at]], {}

        def mixed(d, c, kinds, total, under):
            kept, cut = kinds @ np.array(d), np.array([0, *d])[np.minimum(c, 3)]
            return np.where(total > 0, (np.maximum(c - cut, 0) + kept * under) / np.maximum(total, 1), under)

        for level in range(2, order + 1):
            (c,) = self.find(gram_key(words[order - level :, at], m.bits), m.bits, **{f"grams{level}": 1 if level == order else 2})
            if level == 2:
                total, kinds = total_of[ids[at - 1]], about[ids[at - 1], 2:]
            else:
                own = {f"grams{level - 1}": 2, f"followers{level - 1}": 4 if level == order else 7}
                context, kinds = self.find(gram_key(words[order - level + 1 :, at - 1], m.bits), m.bits, **own)
                total = context[:, 1]
                if level == order:
                    kinds[:, 0] += total - kinds[:, 3]  # those that no shard has told of
                    kinds = kinds[:, :3]
            if level == order or level in further:
                d = m.discounts[-1] if level == order else m.beside[level - 2]
                found[level] = mixed(d, c[:, -1], kinds[:, -3:], total, p)
            if level < order:
                p = mixed(m.discounts[level - 1], c[:, 0], kinds[:, :3], kinds[:, 3], p)
        counts = n[ids[token]]
        base = np.log10((counts + 1) / (m.tokens + 1 * (m.words + 1)))
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        add = lambda x: np.add.reduceat(x, first)
        sums = {level: add(np.log10(x)[back]) for level, x in found.items()}
        return pd.DataFrame(
            {"n_tokens": np.array(sizes, np.int64), "n_known": add((counts > 0).astype(np.int64)), "base_score": add(base), "score": sums[order]} | {f"score_{k}": sums[k] for k in further}
        )


def train(docs: DataFrame, shards: int | None = None, go: int = GO, order: int = ORDER) -> Model:
    """Counts the n-grams of ``order`` words (two at least) of ``docs`` (text) and stores the arrays in the shared folder.

    There are ``SHARDS_EACH`` shards for each partition of ``docs``, at any size, so that a shard stays as large as it is. More
    than 2 ** ``go`` of them are dealt to in two goes: by the first bits of the hash, then by all. The n-grams go through one
    shuffle, whatever the order, and what is owed through another. An empty table gives an empty model.
    """
    if order < 2:
        raise ValueError("an order of two at least")
    spark = docs.sparkSession
    where = re.sub(r"^/", "file:///", new_path(spark, "ngrams"))
    where = re.sub(r"^file:/+", "file:///", where)
    store, root = fs.FileSystem.from_uri(where)
    store.create_dir(root)
    bits = max(0, ((shards or max(1, SHARDS_EACH * docs.rdd.getNumPartitions())) - 1).bit_length())
    word_bits = max(0, bits - 1)
    blobs = docs.select("text").mapInPandas(_count(order, min(bits, go)), BLOBS)
    if bits > go:
        blobs = blobs.repartition("shard").sortWithinPartitions("shard").mapInPandas(_deal(bits, FLUSH), BLOBS)
    owed = blobs.groupBy("shard").applyInPandas(_add_grams(where, order, bits, word_bits, go), OWED)
    if bits > go:
        owed = owed.repartition("part", "slot").sortWithinPartitions("part", "slot").mapInPandas(_deal_owed(bits, word_bits, go, FLUSH), OWED)
    sums = owed.groupBy("part", "slot").applyInPandas(_add_owed(where), "part long, tokens long, words long, types long, n1 long, n2 long, n3 long, n4 long")
    by = {r["part"]: r for r in sums.groupBy("part").agg(*[F.sum(c).alias(c) for c in _SUMS[1:]]).collect()}  # two a level
    counts = lambda part: [by[part][c] if part in by else 0 for c in ("n1", "n2", "n3", "n4")]
    cuts = tuple(discounts(*counts(part)) for part in (1, *range(-2, -order - 1, -1)))
    beside = tuple(discounts(*counts(-level - MARK)) for level in range(2, order))
    tokens, vocabulary, types = (by[1][c] for c in ("tokens", "words", "types")) if 1 in by else (0, 0, 0)
    d, (n1, n2, *_) = cuts[0], counts(1)
    unseen = (d[0] * n1 + d[1] * n2 + d[2] * max(0, vocabulary - n1 - n2)) / types if types else 1.0
    return Model(where, bits, word_bits, tokens, vocabulary, types, cuts, beside, unseen)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", further: tuple[int, ...] = ()) -> DataFrame:
    """Per row of ``docs``: ``id_col``, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Each of ``further``, fewer words than the model's order, adds its score as ``score_<words>``; a text is read once for all of
    them. Null and empty texts have the end alone. Repeated rows each get their row; other columns are not read.
    """
    if not all(2 <= k < len(model.discounts) for k in further):
        raise ValueError("fewer words than the model's, two at least")
    cols = docs.select(as_key(id_col), "text")
    names = [f"score_{k}" for k in further]

    def run(batches):
        lookup = Lookup(model)
        for pdf in batches:
            size = pdf["text"].str.len().fillna(0).cumsum().to_numpy(float)
            for _, part in pdf.groupby(size // (AT_ONCE * 6), sort=False):
                out = lookup.score(list(part["text"]), further)
                out.insert(0, "key", part["key"].to_numpy())
                yield out.assign(train_tokens=model.tokens, perplexity=10 ** np.minimum(300, -out["score"] / out["n_tokens"]))

    kinds = ["key string, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double", *[f"{name} double" for name in names]]
    out = cols.mapInPandas(run, ", ".join(kinds))
    return from_key(out, docs, id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``score`` is that of two words, ``score_3`` that of three; one model gives both."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_remainder(F.col("doc_id"), 7) == 2
    scored = score(docs, train(docs.where(~held_out), order=MOST), further=(ORDER,))
    names = F.col(f"score_{ORDER}").alias("score"), F.col("score").alias(f"score_{MOST}")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", *names)
