"""Quality rules: gradient-boosted trees over document statistics, scored from flat numpy node arrays.

The statistics are counted in one pass over whole texts. The trees are grown on the driver from a bounded sample of
labelled rows (``SAMPLE``), by histograms, with monotonic constraints: a split whose leaves would run against the
constraint of its feature is refused, and the values below it are bounded by the middle of the two sides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import as_key, from_key, table

#: Fixed values of the contract: the symbols counted, the words of a repeated window, the base limits.
SYMBOLS, RUN, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 5, 10, 20
WHITE = " \t\n\x0b\x0c\r"
#: At most about so many labelled rows (by hash of the id) fit the trees.
SAMPLE = 20_000
#: Trees, depth, bins a feature, learning rate, least rows of a leaf, regularisation, and the probability to keep a document.
TREES, DEPTH, BINS, RATE, LEAF, RIDGE, KEEP = 60, 3, 32, 0.2, 10, 1.0, 0.5
#: Features of the trees, and the direction in which the probability of good quality may go with each (0: any).
FEATURES = {
    "log_words": 0, "chars_per_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0,
    "distinct_share": 0, "top_word_share": -1, "mark_share": -1, "run_share": -1, "stop_share": 0,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _hashes(words: list[bytes], known: dict) -> np.ndarray:
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def statistics(text: str | None, known: dict | None = None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The counts of the contract, and the features of the trees, of one whole text (null: no words)."""
    known = {} if known is None else known
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if not n:
        lines = 0
        return (0, 0, sum(map(text.count, SYMBOLS)), lines, 0), (0.0,) * len(FEATURES)
    chars = len(text) - sum(map(text.count, WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    dup = len(lines) - len(set(lines))
    h = _hashes(words, known)
    repeated = 0
    if n >= RUN:
        with np.errstate(over="ignore"):
            window = np.zeros(n - RUN + 1, np.uint64)
            for i in range(RUN):
                window = (window ^ (window >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : n - RUN + 1 + i]
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(window), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, np.nonzero(twice)[0], 1)
        np.add.at(cover, np.nonzero(twice)[0] + RUN, -1)
        repeated = int((np.cumsum(cover[:-1]) > 0).sum())
    _, of = np.unique(h, return_counts=True)
    upper = sum(1 for w in words if w.isupper() and len(w) > 1)
    marks = text.count("!") + text.count("?")
    runs = int((h[1:] == h[:-1]).sum())
    ends = text.count(". ") + text.count(".\n") + text.endswith(".")
    counts = (n, chars, symbols, dup, repeated)
    return counts, (
        float(np.log1p(n)), chars / n, symbols / chars, dup / len(lines), repeated / n, upper / n,
        len(of) / n, float(of.max()) / n, marks / n, runs / n, ends / n,
    )


def _stats(batches):
    for pdf in batches:
        known: dict = {}
        rows = [statistics(t if isinstance(t, str) else None, known) for t in pdf["text"]]
        out = pd.DataFrame(np.array([r[0] for r in rows], np.int64).reshape(-1, len(COUNTS)), columns=list(COUNTS))
        out["features"] = [list(r[1]) for r in rows]
        yield pd.concat([pdf.drop(columns="text").reset_index(drop=True), out], axis=1)


class Trees:
    """Boosted trees as flat arrays: node i splits on feature[i] at cut[i], its children are left[i] and left[i] + 1."""

    def __init__(self, base: float):
        self.base, self.roots, self.feature, self.cut, self.left, self.value = base, [], [], [], [], []

    def add(self, feature: int = -1, cut: float = 0.0, value: float = 0.0) -> int:
        self.feature.append(feature), self.cut.append(cut), self.left.append(-1), self.value.append(value)
        return len(self.feature) - 1

    def frozen(self) -> "Trees":
        self.feature, self.cut, self.left, self.value = (np.array(x) for x in (self.feature, self.cut, self.left, self.value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                f = self.feature[at]
                go = self.left[at] + (x[rows, np.maximum(f, 0)] > self.cut[at])
                at = np.where(f < 0, at, go)
            total += self.value[at]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = TREES) -> Trees:
    """Boosting of the logistic loss; an empty or one-sided sample gives the smoothed base rate alone."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Trees(float(np.log(rate / (1 - rate))))
    if len(y) < 2 * LEAF or y.min() == y.max():
        return model.frozen()
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        model.roots.append(root := model.add())
        todo = [(root, np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            node, rows, depth, lo, hi = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            model.value[node] = RATE * float(np.clip(gs / (hs + RIDGE), lo, hi))
            best = (1e-6,)
            if depth < DEPTH and len(rows) >= 2 * LEAF:
                for f, c in enumerate(cuts):
                    b = binned[rows, f]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                    vl, vr = np.clip(gl / (hl + RIDGE), lo, hi), np.clip((gs - gl) / (hs - hl + RIDGE), lo, hi)
                    gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
                    bad = (nl < LEAF) | (len(rows) - nl < LEAF) | (directions[f] * (vr - vl) < 0)
                    gain = np.where(bad, -1, gain)
                    if len(gain) and gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
            if len(best) == 1:
                margin[rows] += model.value[node]
                continue
            _, f, k, vl, vr = best
            model.feature[node], model.cut[node] = f, float(cuts[f][k])
            model.left[node] = left = model.add()
            right, mid = model.add(), (vl + vr) / 2
            bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[directions[f]]
            goes = binned[rows, f] <= k
            todo += [(left, rows[goes], depth + 1, *bounds[0]), (right, rows[~goes], depth + 1, *bounds[1])]
    return model.frozen()


def sample_labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", bound: int = SAMPLE) -> DataFrame:
    """(key, text, label): at most about ``bound`` labelled rows, by hash of the id; labels of all rows are counted."""
    marked = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.min(label).cast("int").alias("label"))
    n = marked.count()
    if n > bound:
        marked = marked.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    return docs.select(F.col(id_col).alias("key"), "text").join(F.broadcast(marked), "key")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality") -> Trees:
    sample = sample_labelled(docs, labels, label, id_col)
    kind = dict(sample.dtypes)["key"]
    rows = sample.mapInPandas(_stats, f"key {kind}, label int, {', '.join(f'{c} long' for c in COUNTS)}, features array<double>")
    rows = rows.groupBy("key").agg(F.min(F.struct("label", "features")).alias("row")).select("key", "row.*").toPandas().sort_values("key")  # repeated rows count once
    x = np.array(rows["features"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["label"].to_numpy(float), list(FEATURES.values()))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", keep: float = KEEP) -> DataFrame:
    """Per row of ``docs``: ``id_col``, the counts, base_failed, score (probability of good quality), kept.

    Null and wordless texts have no words and fail the base rule. Without usable labels the base rule alone decides.
    Repeated rows each get their row; other columns of either table are not read.
    """
    model = train(docs, labels, id_col)
    cols = docs.select(as_key(id_col), "text")

    def score(batches):
        for pdf in _stats(batches):
            x = np.array(pdf.pop("features").tolist(), float).reshape(-1, len(FEATURES))
            n, rep = pdf["n_words"].to_numpy(), pdf["n_repeat_words"].to_numpy()
            failed = (n < LEAST_WORDS) | (100 * rep > MOST_REPEATED * n)
            p = model.probability(x)
            yield pdf.assign(base_failed=failed, score=p, kept=~failed & (p >= keep))

    out = cols.mapInPandas(score, f"key string, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, score double, kept boolean")
    return from_key(out, docs, id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; rows never leave their partition."""
    model = train(docs, labels, id_col)

    def run(batches):
        for batch in batches:
            known: dict = {}
            rows = [statistics(t, known) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            n, rep = (np.array([r[0][i] for r in rows], np.int64) for i in (0, 4))
            p = model.probability(np.array([r[1] for r in rows], float).reshape(-1, len(FEATURES)))
            good = (n >= LEAST_WORDS) & (100 * rep <= MOST_REPEATED * n) & (p >= keep)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
