"""Quality classifier by co-training of a text-content view and a page-metadata view.

Each view turns a document into a set of hashed features and has a classifier of its own: a regression on the features whose
association with the label is significant, calibrated by a logistic curve. The content view sees the text alone, the
metadata view only stored columns: source, language, their pair and the stored length. One pass over whole texts turns
all documents into features. Over rounds, each view scores all unlabelled documents in Spark, and the few that it is
most sure of, of the whole table, teach the other. At last the calibrated views are combined by a logistic curve fitted
on held-back labels, and score all documents. Only the labelled rows that fit the views are sampled (``SAMPLE``).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import as_key, from_key, stash, table

#: At most about so many labelled rows, by hash of the id.
SAMPLE = 4000
#: Hash slots; least |z| of a feature's association; rounds; pseudo-labels a view gives in a round; how sure it must be.
SLOTS, LEAST_Z, ROUNDS, GIVEN, SURE = 1 << 20, 4.0, 3, 400, 0.95
#: Parts in which the surest documents are sought before they are sought among all; how many times as many a task sends on.
PARTS, SLACK = 64, 4
#: Steps of a view's regression, their size, and its ridge.
STEPS, RATE, RIDGE = 120, 0.3, 0.5
#: The score below which a document is rejected, and the toxicity above which it is.
KEEP, TOXIC = 0.5, 0.5
WORD = re.compile(r"[^\W\d_]+")


def _bin(name: str, x: float, edges: tuple) -> str:
    return f"{name}:{int(np.searchsorted(edges, x, side='right'))}"


SHARES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7)


def content_view(text: str) -> list[str]:
    """Distinct words and their first letters; binned layout, and shares of symbols, capitals, repeats and variety."""
    tokens, lines = text.split(), text.split("\n")
    words = WORD.findall(text.lower())
    n, chars = max(1, len(tokens)), max(1, len(text))
    seen = set(words)
    out = [f"w {w}" for w in seen] + [f"p {w[:5]}" for w in seen if len(w) > 5]
    again = sum(a == b for a, b in zip(tokens, tokens[1:])) / n
    symbols = sum(map(text.count, "#*$%&|<>")) / chars
    out += [_bin("again", again, SHARES), _bin("symbols", symbols, (0.005, *SHARES)), _bin("loud", (text.count("!") + text.count("?")) / chars, (0.005, *SHARES))]
    out += [_bin("upper", sum(map(str.isupper, text)) / chars, (0.05, 0.1, 0.2, 0.4, 0.6)), _bin("variety", len(seen) / max(1, len(words)), (0.1, 0.2, 0.3, 0.4, 0.5, 0.7))]
    out += [_bin("letters", sum(map(len, words)) / chars, (0.3, 0.5, 0.6, 0.7, 0.8)), _bin("stops", text.count(".") / n, (0.005, 0.02, 0.05, 0.1, 0.2, 0.4))]
    out += [_bin("lines", np.log2(len(lines)), tuple(range(1, 12))), _bin("line", np.log2(1 + len(text) / len(lines)), tuple(range(3, 16)))]
    out += [_bin("token", chars / n, (3, 4, 5, 6, 7, 8, 10, 15)), _bin("same", 1 - len(set(lines)) / len(lines), SHARES), _bin("blank", sum(not x.strip() for x in lines) / len(lines), SHARES)]
    return out


def metadata_view(lang, source, n_chars) -> list[str]:
    """Source, language, both, and the binned stored length, by itself and with each; missing values are values."""
    long = "none" if n_chars is None or n_chars != n_chars else str(int(np.log2(1 + max(0, int(n_chars))) * 2))
    return [f"source {source}", f"lang {lang}", f"both {source} {lang}", f"long {long}", f"source {source} long {long}", f"lang {lang} long {long}"]


class Hasher:
    """Slots of features, those of the words of recent texts kept."""

    def __init__(self, most: int = 300_000):
        self.known, self.most = {}, most

    def __call__(self, features: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        out = []
        for f in features:
            h = known.get(f)
            if h is None:
                h = known[f] = xxhash.xxh64_intdigest(f) % SLOTS
            out.append(h)
        return np.array(sorted(set(out)), np.int32)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (bias last) of a small logistic regression by Newton steps."""
    x = np.column_stack([x, np.ones(len(y))])
    w, weight = np.zeros(x.shape[1]), np.ones(len(y)) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


class View:
    """A logistic regression on the significant features of one view, and the curve that calibrates it."""

    def __init__(self):
        self.weights, self.curve = np.zeros(SLOTS, np.float32), np.zeros(2)

    def fit(self, rows: list[np.ndarray], y: np.ndarray, steps: int = STEPS) -> "View":
        sizes = np.array([len(r) for r in rows], np.int64)
        at, doc = np.concatenate(rows) if rows else np.zeros(0, np.int64), np.repeat(np.arange(len(rows)), sizes)
        n, rate = len(y), (y.sum() + 0.5) / (len(y) + 1)
        have, good = np.bincount(at, minlength=SLOTS), np.bincount(at, y[doc], SLOTS)
        z = (good - have * rate) / np.sqrt(np.maximum(1e-9, have * rate * (1 - rate) * (1 - have / (n + 1))))
        chosen = np.nonzero((np.abs(z) >= LEAST_Z) & (have >= 3))[0]
        number = np.full(SLOTS, -1)
        number[chosen] = np.arange(len(chosen))
        own = number[at] >= 0
        at, doc = number[at[own]], doc[own]
        w, bias = np.zeros(len(chosen)), float(np.log(rate / (1 - rate)))
        grown, grown_bias = np.full(len(chosen), 1e-6), 1e-6
        fold = np.arange(n) % 5 == 4  # calibrates, doesn't teach
        if y[fold].min(initial=1) == y[fold].max(initial=0) or n < 50:
            fold[:] = False
        teach = ~fold[doc]
        for _ in range(steps):
            miss = y - 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[at], n) + bias, -30, 30)))
            miss[fold] = 0
            g = np.bincount(at[teach], miss[doc[teach]], len(chosen)) - RIDGE * w
            grown += g**2
            w += RATE * g / np.sqrt(grown)
            grown_bias += miss.sum() ** 2
            bias += RATE * miss.sum() / np.sqrt(grown_bias)
        self.weights = np.zeros(SLOTS, np.float32)
        self.weights[chosen] = w
        rows_of = np.nonzero(fold if fold.any() else ~fold)[0]
        self.curve = _logistic(self.sums([rows[i] for i in rows_of])[:, None], y[rows_of], ridge=0.1)
        return self

    def sums(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() for r in rows], float)

    def probability(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.sums(rows) * self.curve[0] + self.curve[1], -30, 30)))


class Pair:
    """Both views of one target, taught by labelled rows and by what the other view has told them."""

    def __init__(self, content: list, meta: list, y: np.ndarray):
        self.sets, self.y = (content, meta), y
        held = np.arange(len(y)) % 4 == 3  # for the last curve
        if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
            held[:] = False
        self.held, self.own = held, np.nonzero(~held)[0]
        self.told: tuple[dict, dict] = ({}, {})  # for each view: features of a pool row as bytes -> label
        self.learn()

    def learn(self) -> None:
        self.views = []
        for v in (0, 1):
            rows = [self.sets[v][i] for i in self.own] + [np.frombuffer(k, np.int64) for k in self.told[v]]
            self.views.append(View().fit(rows, np.concatenate([self.y[self.own], np.array(list(self.told[v].values()), float)])))

    def wanted(self, label: int) -> int:
        """Pseudo-labels of this kind that a view gives in a round: in the proportion of the labels."""
        rate = self.y[self.own].mean()
        return max(1, round(GIVEN * (rate if label else 1 - rate)))

    def finish(self) -> tuple[View, View, np.ndarray]:
        rows = np.nonzero(self.held if self.held.any() else ~self.held)[0]
        logits = np.column_stack([_logit(self.views[v].probability([self.sets[v][i] for i in rows])) for v in (0, 1)])
        return self.views[0], self.views[1], _logistic(logits, self.y[rows], ridge=1.0)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def packed(slots: np.ndarray) -> bytes:
    """Sorted slots as their differences, byte planes apart: what compresses best."""
    return np.ascontiguousarray(np.diff(slots, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)


def _hashed(batches):
    hasher = Hasher()
    for pdf in batches:
        content = [packed(hasher(content_view(t if isinstance(t, str) else ""))) for t in pdf["text"]]
        meta = [packed(hasher(metadata_view(*row))) for row in zip(pdf["lang"], pdf["source"], pdf["n_chars"])]
        yield pdf[["key"]].assign(tie=np.array([xxhash.xxh64_intdigest(c) >> 1 for c in content], np.int64), content=content, meta=meta)


def features(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(key, tie, content, meta) per row of ``docs``, written to the shared folder: the id as text, a hash of the content's
    features, and the packed feature slots of both views."""
    n_chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    cols = docs.select(as_key(id_col), "text", F.col("lang").cast("string"), F.col("source").cast("string"), n_chars.alias("n_chars"))
    return stash(cols.mapInPandas(_hashed, "key string, tie long, content binary, meta binary"), "features", compression="zstd")


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", bound: int = SAMPLE):
    """(labelled sample as pandas, ids with a label). Several labels of an id count as the worst; repeated rows as one."""
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marks = stash(marks, "marks")
    lot = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000))
    some = F.broadcast(marks.where(lot < int(1_000_000 * min(1, bound / max(1, marks.count())))))  # about `bound` rows
    known = rows.join(some, rows["key"] == some["id"]).groupBy("key").agg(F.min(F.struct("quality", "toxic", "content", "meta")).alias("row"))
    return known.select("key", "row.*").toPandas().sort_values("key", kind="stable"), marks.select("id")


def surest(rows: DataFrame, marks: DataFrame, views: dict, wanted: dict, done: dict, sure: float = SURE, slack: int = SLACK) -> list:
    """Of all ``rows`` without a label (ids in ``marks``), those that each view is most sure of, one per content: (target, view,
    label, sure, tie, content, meta).

    ``views`` and ``done`` (hashes of contents that the view has told already) are by (target, view), ``wanted`` by (target,
    label). Ties go by the hash of the content; of rows of one content that of the smallest key teaches. A task sends on
    the keys and hashes of its best ``slack`` times as many; were labelled ones among them so many that a row it has held
    back could be wanted, all is done again with more.
    """

    def run(batches):
        held, cut = {}, {}
        for pdf in batches:
            slots = {v: [unpacked(x) for x in pdf["meta" if v else "content"]] for v in {v for _, v in views}}
            for (target, v), view in views.items():
                p = view.probability(slots[v])
                for label, q in ((1, p), (0, 1 - p)):
                    at, most = (target, v, label), slack * wanted[target, label]
                    now = pdf[["key", "tie"]].assign(target=target, view=v, label=label, sure=q, held_back=False)[q >= sure]
                    now = pd.concat([held.get(at, now[:0]), now[~now["tie"].isin(done[target, v])]])
                    if len(now) > 2 * most:
                        before, now = len(now), _best(now, most)
                        if len(now) < before:
                            cut[at] = max(cut.get(at, 0.0), float(now["sure"].iloc[-1]))
                    held[at] = now.reset_index(drop=True)
        for at, now in held.items():
            yield now
            if at in cut:
                yield pd.DataFrame([(None, 0, *at, cut[at], True)], columns=now.columns)

    found = stash(rows.select("key", "tie", "content", "meta").mapInPandas(run, "key string, tie long, target string, view int, label int, sure double, held_back boolean"), "surest")
    by = ["target", "view", "label"]
    most = F.coalesce(*[F.when((F.col("target") == t) & (F.col("label") == k), F.lit(n)) for (t, k), n in wanted.items()])
    free = found.where(~F.col("held_back")).join(marks, F.col("key") == F.col("id"), "left_anti")
    best = free.groupBy(*by, "tie").agg(F.max("sure").alias("sure"), F.min("key").alias("key"))
    for parts in ([*by, F.pmod("tie", F.lit(PARTS))], by):
        place = F.row_number().over(Window.partitionBy(*parts).orderBy(F.desc("sure"), "tie"))
        best = best.withColumn("place", place).where(F.col("place") <= most)
    best = stash(best.drop("place"), "chosen")  # GIVEN rows a view and target at most
    last = best.groupBy(*by).agg(F.min("sure").alias("last"), F.count(F.lit(1)).alias("n"))
    short = found.where("held_back").groupBy(*by).agg(F.max("sure").alias("cut")).join(last, by, "left").where((F.coalesce("n", F.lit(0)) < most) | (F.col("cut") >= F.col("last")))
    if not short.isEmpty():
        return surest(rows, marks, views, wanted, done, sure, 4 * slack)
    own = F.broadcast(best.select("tie", F.col("key").alias("own")).distinct())
    there = rows.join(own, "tie").where(F.col("key").eqNullSafe(F.col("own"))).groupBy("tie", "own").agg(F.min(F.struct("content", "meta")).alias("row"))
    joined = best.join(there.withColumnRenamed("tie", "_tie"), (F.col("tie") == F.col("_tie")) & F.col("key").eqNullSafe(F.col("own")))
    return joined.select(*by, "sure", "tie", "row.content", "row.meta").orderBy(*by, F.desc("sure"), "tie").collect()


def _best(rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """The first ``n`` contents, all rows of each: some may have a label."""
    rows = rows.sort_values(["sure", "tie"], ascending=[False, True], kind="stable")
    place = (rows["tie"] != rows["tie"].shift()).cumsum()
    return rows[place <= n]


def train(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", bound: int = SAMPLE, rounds: int = ROUNDS) -> dict:
    """Co-trained views for good quality and for toxicity (None where labels don't suffice) from the ``features`` of all rows."""
    known, marks = labelled(rows, labels, id_col, bound)
    pairs = {}
    for target in ("quality", "toxic"):
        own = known[known[target].notna()]
        y = own[target].to_numpy(float)
        if len(y) >= 10 and y.min() != y.max():
            slots = lambda c: [unpacked(x) for x in own[c]]  # noqa: E731, B023
            pairs[target] = Pair(slots("content"), slots("meta"), y)
    done = {(t, v): [] for t in pairs for v in (0, 1)}
    for _ in range(rounds if pairs else 0):
        views = {(t, v): pair.views[v] for t, pair in pairs.items() for v in (0, 1)}
        new = surest(rows, marks, views, {(t, k): pair.wanted(k) for t, pair in pairs.items() for k in (0, 1)}, done)
        if not new:
            break
        for r in new:
            other = 1 - r["view"]
            row = unpacked(bytes(r["meta"] if other else r["content"])).tobytes()
            pairs[r["target"]].told[other].setdefault(row, float(r["label"]))
            done[r["target"], r["view"]].append(r["tie"])
        for pair in pairs.values():
            pair.learn()
    return {target: pairs[target].finish() if target in pairs else None for target in ("quality", "toxic")}


def classify(rows: DataFrame, models: dict, keep: float = KEEP, toxic: float = TOXIC) -> DataFrame:
    """Per row of ``features``: key, content_score, metadata_score, score, toxic_score, kept.

    ``score`` is the combined probability of good quality, ``toxic_score`` that of toxicity; a document is kept if the
    first reaches ``keep`` and the second stays below ``toxic``. A target without a model scores 1 (quality) or 0 (toxicity).
    """

    def scores(model, content, meta, default):
        if model is None:
            return (np.full(len(content), default),) * 3
        a, b, w = model[0].probability(content), model[1].probability(meta), model[2]
        return a, b, 1 / (1 + np.exp(-np.clip(_logit(a) * w[0] + _logit(b) * w[1] + w[2], -30, 30)))

    def run(batches):
        for pdf in batches:
            content, meta = ([unpacked(x) for x in pdf[c]] for c in ("content", "meta"))
            a, b, good = scores(models["quality"], content, meta, 1.0)
            bad = scores(models["toxic"], content, meta, 0.0)[2]
            yield pd.DataFrame({"key": pdf["key"], "content_score": a, "metadata_score": b, "score": good, "toxic_score": bad, "kept": (good >= keep) & (bad < toxic)})

    return rows.mapInPandas(run, "key string, content_score double, metadata_score double, score double, toxic_score double, kept boolean")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: ``id_col`` and what ``classify`` finds.

    Null texts count as empty, null lang, source and n_chars (or none such column) as values of their own. Repeated rows
    each get their row; of the other columns none is read.
    """
    rows = features(docs, id_col)
    return from_key(classify(rows, train(rows, labels, id_col)), docs, id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
