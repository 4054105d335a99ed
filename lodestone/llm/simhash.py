"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints that are equal are one node from the start. Two fingerprints within ``radius`` bits agree in at least
``n - radius`` of ``n`` bit bands, whatever ``n`` is, so the tiles are laid within groups that agree in so many bands:
nothing is lost. The number of bands follows the table: more bands make more, but far smaller groups, and the groups are
counted before anything is compared, so that a fingerprint meets ``GROUP`` others a band set at most on average. Only
where more bands don't part them, as in a dense cloud of near copies, are groups larger. A group of more than ``TILE``
fingerprints is cut by hash, and a task gets pairs of such parts; there it sorts them by population count, cuts them into
tiles and compares these with numpy exclusive-or and bit counts. Tile pairs whose population counts differ beyond the
radius are skipped, and only a spanning forest of the links found leaves the task. The components are then joined by
min-label hooking and pointer jumping in Spark.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import as_key, from_key, stash, table

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Fingerprints of a tile; how many others a fingerprint may meet in a group on average; most bands (70 sets of 4 of 8).
TILE, GROUP, BANDS = 4096, 256, 8


def fingerprints(texts: pd.Series, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit SimHash of each text (null: no words, fingerprint zero) as unsigned integers."""
    out = np.zeros(len(texts), np.uint64)
    weights = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
        if not words:
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        line = b" ".join(words)
        if len(words) <= shingle:
            hashes = [digest(line, SEED)]
        else:
            begins = [0, *(ends[: len(words) - shingle] + 1).tolist()]
            hashes = [digest(line[a:b], SEED) for a, b in zip(begins, ends[shingle - 1 :].tolist())]
        ones, all_hashes = np.zeros(64, np.int64), np.array(hashes, "<u8")
        for i in range(0, len(all_hashes), 65536):  # bounded memory for very long texts
            part = all_hashes[i : i + 65536]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = weights[ones * 2 > len(all_hashes)].sum(dtype=np.uint64)
    return out


def _fingerprint(batches):
    for pdf in batches:
        yield pdf.drop(columns="text").assign(fp=fingerprints(pdf["text"]).view(np.int64))


def _roots(parent: np.ndarray) -> np.ndarray:
    while (up := parent[parent] != parent).any():
        parent[up] = parent[parent[up]]
    return parent


def spanning(a: np.ndarray, b: np.ndarray | None, radius: int, step: int = 512) -> list[tuple[int, int]]:
    """Links that connect what lies within ``radius`` bits in a x b (b None: a x a), as pairs of places in a then b."""
    nodes = a if b is None else np.concatenate([a, b])
    label, links = np.arange(len(nodes)), []
    count, base = np.bitwise_count(nodes).astype(np.int64), 0 if b is None else len(a)
    other = nodes[base:]
    for i in range(0, len(a), step):
        rows = slice(i, min(i + step, len(a)))
        for j in range(i if b is None else 0, len(other), step):
            cols = slice(j, min(j + step, len(other)))
            pa, pb = count[rows], count[base + j : base + cols.stop]
            if pa.min() - pb.max() > radius or pb.min() - pa.max() > radius:
                continue
            near = np.bitwise_count(a[rows, None] ^ other[None, cols]) <= radius
            near &= label[rows, None] != label[None, base + j : base + cols.stop]
            while near.any():  # each round joins every tree that has a link with one other at least
                x, y = np.nonzero(near)
                x, y = x + i, y + base + j
                lx, ly = label[x], label[y]
                hi, lo = np.maximum(lx, ly), np.minimum(lx, ly)
                kept = np.unique(hi, return_index=True)[1]
                parent = np.arange(len(nodes))
                parent[hi[kept]] = lo[kept]
                links += zip(x[kept].tolist(), y[kept].tolist())
                label = _roots(parent)[label]
                near &= label[rows, None] != label[None, base + j : base + cols.stop]
    return links


def _compare(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy().view(np.uint64)
        order = np.argsort(np.bitwise_count(fp), kind="stable")
        fp, side = fp[order], pdf["side"].to_numpy()[order]
        a, b = fp[side == 0], fp[side == 1]
        if len(b) == 0 and len(a):
            nodes, links = a, spanning(a, None, radius)
        else:
            nodes, links = np.concatenate([a, b]), spanning(a, b, radius)
        pairs = np.array(links, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": nodes[pairs[:, 0]].view(np.int64), "b": nodes[pairs[:, 1]].view(np.int64)})

    return run


def band_sets(bands: int, radius: int = RADIUS) -> list[int]:
    """Masks of the bits that a group shares: all sets of ``bands - radius`` of the bands that 64 bits are cut into."""
    cuts = [64 * i // bands for i in range(bands + 1)]
    masks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(bands)]
    chosen = [sum(some) for some in combinations(masks, bands - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in chosen]


def _grouped(nodes: DataFrame, bands: int, radius: int):
    """(rows by band set, the groups of more than one of them)."""
    masks = band_sets(bands, radius)
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("band", "part"))
    return keyed, stash(keyed.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")


def groups(nodes: DataFrame, radius: int = RADIUS, group: int = GROUP, most: int = BANDS):
    """Rows by band set, and their groups: of so many bands that the comparisons are in proportion to the fingerprints.

    From the number of bands that evenly spread fingerprints would need, it goes on to more while their groups are larger
    than that and another band still saves half of the comparisons.
    """
    n, bands = nodes.count(), radius + 1
    while bands < most and n >> (64 * (bands - radius) // bands) > group:
        bands += 1
    met = F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))
    now = _grouped(nodes, bands, radius)
    pairs = now[1].agg(met).first()[0]
    while bands < most and pairs > group / 2 * n * len(band_sets(bands, radius)):
        further = _grouped(nodes, bands + 1, radius)
        fewer = further[1].agg(met).first()[0]
        if 2 * fewer > pairs:
            break
        bands, now, pairs = bands + 1, further, fewer
    return now


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, group: int = GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect exactly what lies within ``radius`` bits."""
    keyed, sizes = groups(nodes, radius, group)
    # A group of more than one tile is cut by hash; its rows go to each pair of tiles that they are in.
    tiles = F.ceil(F.col("n") / tile).cast("int")
    placed = keyed.join(sizes, ["band", "part"]).select("fp", "band", "part", tiles.alias("tiles"), F.pmod(F.xxhash64("fp"), tiles).cast("int").alias("mine"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = pairs.select("fp", "band", "part", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    # Groups are small and very many: a task gets whole tile pairs by hash, and cuts them apart itself.
    by = ["band", "part", "i", "j"]
    return pairs.repartition(*by).sortWithinPartitions(*by).select(*by, "fp", "side").mapInPandas(_in_turn(radius), "a long, b long")


def _in_turn(radius: int):
    """Compares the tile pairs that a task has got, one after another; rows come sorted by tile pair."""
    one = _compare(radius)

    def run(batches):
        rest = None
        by = ["band", "part", "i", "j"]
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            change = (pdf[by] != pdf[by].shift()).any(axis=1).to_numpy()
            starts = np.nonzero(change)[0]
            rest = pdf.iloc[starts[-1] :]
            yield from _each(one, pdf, starts)
        if rest is not None:
            yield one(rest)

    return run


def _each(one, pdf, starts):
    fp, side = pdf["fp"].to_numpy(), pdf["side"].to_numpy()
    out = []
    for a, b in zip(starts[:-1], starts[1:]):
        if b - a > 1:
            out.append(one(pd.DataFrame({"fp": fp[a:b], "side": side[a:b]})))
    if out:
        yield pd.concat(out, ignore_index=True)


def _label(nodes: DataFrame):
    """What the smallest of a component is found by: its id (nulls last), its text hash if there is one, its fingerprint."""
    more = [c for c in nodes.columns if c == "hash"]
    return F.struct(F.col("low").isNull().alias("none"), "low", *more, F.col("fp").alias("at"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, component) for the nodes (fp, low) that have links: the smallest ``low`` reachable. Null lows count as largest."""
    return _labels(edges, nodes).select("fp", F.col("label.low").alias("component"))


def _labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fp, label) for the nodes that have links: the smallest label reachable."""
    both = stash(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    first = both.select(F.col("u").alias("fp")).distinct().join(nodes, "fp").select("fp", _label(nodes).alias("label"))
    labels = stash(first, "labels")
    while True:
        # hook: each node takes the smallest label around it; jump: then the label of the node that its label names
        around = both.join(labels.select(F.col("fp").alias("v"), "label"), "v").groupBy(F.col("u").alias("fp")).agg(F.min("label").alias("near"))
        hooked = stash(labels.join(around, "fp").select("fp", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved")), "hooked")
        if hooked.where("moved").isEmpty():
            return labels
        jump = hooked.select(F.col("fp").alias("at"), F.col("label").alias("further"))
        labels = stash(hooked.withColumn("at", F.col("label.at")).join(jump, "at").select("fp", F.least("label", "further").alias("label")), "labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Per row of ``docs``: ``id_col``, fingerprint (16 hex digits), component_id.

    Null, empty and wordless texts have fingerprint zero and are linked like any other. A null id is never the smallest
    unless all ids of its component are null. Repeated rows each get their row; other columns are not read.
    """
    cols = docs.select(as_key(id_col), "text")
    prints = stash(from_key(cols.mapInPandas(_fingerprint, "key string, fp long"), docs, id_col, "key"), "fingerprints")
    nodes = stash(prints.groupBy("fp").agg(F.min("key").alias("low")), "nodes")
    labels = components(stash(links(nodes, radius, tile), "links"), nodes)
    named = stash(nodes.join(labels, "fp", "left").select("fp", F.coalesce("component", "low").alias("component_id")), "named")
    return prints.join(named, "fp").select(F.col("key").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def _text_hash(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row of ``docs`` of each near-duplicate group, with all its columns: that of the smallest id, null ids last.

    Ids may be null or come with several texts, so (id, hash of the text) decides; of several texts of a group's smallest
    id, the one with the smallest hash stays, of rows that repeat both the first by their other columns. What goes or is
    repeated is less than what stays, so texts meet the former: where it is little, no text is shuffled.
    """
    cols = docs.select(as_key(id_col), _text_hash(docs).alias("hash"), "text")
    prints = stash(from_key(cols.mapInPandas(_fingerprint, "key string, hash long, fp long"), docs, id_col, "key"), "fingerprints")
    low = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "hash"))
    nodes = stash(prints.groupBy("fp").agg(low.alias("low")).select("fp", F.col("low.key").alias("low"), F.col("low.hash").alias("hash")), "nodes")
    labels = _labels(stash(links(nodes, radius, tile), "links"), nodes)
    named = stash(nodes.join(labels, "fp", "left").select("fp", F.coalesce("label", _label(nodes)).alias("label")), "named")
    stays = F.col("key").eqNullSafe(F.col("label.low")) & (F.col("hash") == F.col("label.hash"))
    pairs = prints.join(named, "fp").select(F.col("key").alias("other_id"), F.col("hash").alias("other_hash"), stays.alias("stays"))
    others = stash(pairs.groupBy("other_id", "other_hash", "stays").agg(F.count(F.lit(1)).alias("n")).where("not stays or n > 1"), "others")
    same = lambda these: docs[id_col].eqNullSafe(these["other_id"]) & (_text_hash(docs) == these["other_hash"])
    kept, repeated = docs.join(others, same(others), "left_anti"), others.where("stays")
    if repeated.isEmpty():
        return kept
    again = docs.join(repeated, same(repeated), "left_semi")
    rest = F.struct(*[again[f"`{c}`"] for c in again.columns if c != "text"])
    first = F.min_by(F.struct(*[again[f"`{c}`"] for c in again.columns]), F.struct(again["text"].isNull(), F.to_json(rest)))
    return kept.unionByName(again.groupBy(again[id_col].alias("_id"), _text_hash(again).alias("_hash")).agg(first.alias("_row")).select("_row.*"))
