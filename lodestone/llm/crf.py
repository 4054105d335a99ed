"""Language identification of code-switched text by a linear-chain conditional random field.

Each word (a run of letters, lower-cased) gets an emission score per language from hashed character n-grams of up to
four letters with word-end marks (those at the ends are the affixes) and from a lexicon; learned transitions join
neighbouring words. Forward-backward gives each word's posterior; a document's language is the one with the largest
mean posterior. The field is fitted on the driver from a bounded sample of labelled segments (``SAMPLE``), half of them
spliced from several languages so that the transitions learn switches. Texts are scored whole: chains are cut into
blocks whose transfer matrices are multiplied, so that numpy works on all blocks of a batch at once.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import as_key, crc_remainder, from_key, table

#: Labelled documents a language that fit the field (about so many, by hash of the id); words of a training segment.
SAMPLE, SEGMENT = 600, 48
#: Languages that are learned at most: those with the most labelled rows; documents that fit the field in all.
LANGS, MOST = 50, 4000
#: Hash slots of the n-grams, longest n-gram, entries of the lexicon at most.
SLOTS, NGRAM, LEXICON = 1 << 17, 4, 50_000
#: Steps of the fit, its step size and its ridge; words of a block; words scored at once; words whose emissions are kept.
STEPS, RATE, RIDGE, BLOCK, AT_ONCE, KNOWN = 40, 0.5, 1e-4, 32, 300_000, 200_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(text) -> list[str]:
    """The runs of letters of ``text``, lower-cased."""
    return WORD.findall(text.lower()) if isinstance(text, str) else []


class Field:
    """langs; weights of the hashed n-grams; lexicon word -> scores; weights of the lexicon scores; transitions; start."""

    def __init__(self, langs: list[str], lexicon: dict[str, np.ndarray]):
        k = len(langs)
        self.langs, self.lexicon = langs, lexicon
        self.grams, self.lex = np.zeros((SLOTS, k), np.float32), np.zeros((k, k))
        self.moves, self.start = np.zeros((k, k)), np.zeros(k)

    def emissions(self, words: list[str]) -> np.ndarray:
        slot, owner, scale, lex = self.features(words)
        out = np.zeros((len(words), len(self.langs)))
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(owner, self.grams[slot, k], len(words)) * scale
        return out + lex @ self.lex

    def features(self, words: list[str]):
        """Slots of the n-grams, the word of each, the scale of each word's sum, and the lexicon scores."""
        k = len(self.langs)
        none = np.zeros(k)
        lex = np.array([self.lexicon.get(w, none) for w in words]).reshape(-1, k)
        text = "".join(f"\x02{w}\x03" for w in words)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        owner = np.repeat(np.arange(len(words)), sizes)
        slots, owners, h = [], [], np.zeros(len(code), np.uint64)
        for n in range(1, NGRAM + 1):
            if len(code) < n:
                break
            with np.errstate(over="ignore"):
                h = (h[: len(code) - n + 1] + code[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            inside = owner[: len(h)] == owner[n - 1 :]
            slots.append((h[inside] >> np.uint64(20)) % np.uint64(SLOTS))
            owners.append(owner[: len(h)][inside])
        slot = np.concatenate(slots).astype(np.int64) if slots else np.zeros(0, np.int64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        return slot, owner, 2 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(words)))), lex


def _padded(scores: np.ndarray, moves: np.ndarray, start: np.ndarray, here: np.ndarray):
    """Forward-backward over padded sequences: posteriors (b, t, k) and expected moves (k, k)."""
    b, t, k = scores.shape
    psi, a = np.exp(scores - scores.max(2, keepdims=True)), np.exp(moves)
    alpha, beta = np.zeros((t, b, k)), np.ones((t, b, k))
    now = np.exp(start) * psi[:, 0]
    alpha[0] = now / now.sum(1, keepdims=True)
    for i in range(1, t):
        now = alpha[i - 1] @ a * psi[:, i]
        alpha[i] = np.where(here[:, i, None], now / now.sum(1, keepdims=True), alpha[i - 1])
    total = np.zeros((k, k))
    for i in range(t - 1, 0, -1):
        back = psi[:, i] * beta[i]
        pair = alpha[i - 1][:, :, None] * a * back[:, None, :] * here[:, i, None, None]
        total += (pair / np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)).sum(0)
        now = back @ a.T
        beta[i - 1] = np.where(here[:, i, None], now / now.sum(1, keepdims=True), beta[i])
    post = alpha * beta
    return (post / post.sum(2, keepdims=True)).transpose(1, 0, 2), total


def fit(sample: list[tuple[str, list[str]]], steps: int = STEPS, seed: int = 1) -> Field | None:
    """The field of labelled word segments by gradient steps of bounded size; None without a labelled word."""
    sample = [(lang, words) for lang, words in sample if words]
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return None
    counts: dict[str, np.ndarray] = {}
    for lang, words in sample:
        for w in words:
            counts.setdefault(w, np.zeros(len(langs)))[langs.index(lang)] += 1
    top = sorted((w for w in counts if counts[w].sum() >= 3), key=lambda w: (-counts[w].sum(), w))[:LEXICON]
    totals = sum(counts.values()) + 1
    odds = {w: np.log((counts[w] + 0.5) / totals) for w in top}
    field = Field(langs, {w: (v - v.mean()) / 4 for w, v in odds.items()})

    rng = np.random.default_rng(seed)
    by = {lang: [words for own, words in sample if own == lang] for lang in langs}
    chains: list[tuple[list[str], list[int]]] = []
    for i, (lang, words) in enumerate(sample):
        if i % 2 == 0 or len(langs) == 1:
            chains.append((words[:SEGMENT], [langs.index(lang)] * len(words[:SEGMENT])))
            continue
        mixed, marks, at = [], [], langs.index(lang)
        while len(mixed) < SEGMENT:
            piece = by[langs[at]][rng.integers(len(by[langs[at]]))]
            n = int(rng.integers(4, 17))
            begin = int(rng.integers(max(1, len(piece) - n)))
            mixed += piece[begin : begin + n]
            marks += [at] * len(piece[begin : begin + n])
            at = int(rng.integers(len(langs)))
        chains.append((mixed[:SEGMENT], marks[:SEGMENT]))
    vocab = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in chains for w in words))}
    ids, want, here = (np.zeros((len(chains), SEGMENT), x) for x in (np.int64, np.int64, bool))
    for i, (words, marks) in enumerate(chains):
        ids[i, : len(words)], want[i, : len(words)], here[i, : len(words)] = [vocab[w] for w in words], marks, True
    slot, owner, scale, lex = field.features(list(vocab))
    k = len(langs)
    truth = np.eye(k)[want] * here[:, :, None]
    moved = np.zeros((k, k))
    np.add.at(moved, (want[:, :-1][here[:, 1:]], want[:, 1:][here[:, 1:]]), 1)
    sums = [1e-8 * np.ones_like(x, dtype=float) for x in (field.grams, field.lex, field.moves, field.start)]
    for _ in range(steps):
        score = np.stack([np.bincount(owner, field.grams[slot, c], len(vocab)) * scale for c in range(k)], axis=1) + lex @ field.lex
        post, expected = _padded(score[ids], field.moves, field.start, here)
        miss = truth - post * here[:, :, None]
        of_word = np.stack([np.bincount(ids.ravel(), miss[:, :, c].ravel(), len(vocab)) for c in range(k)], axis=1)
        slopes = (
            np.stack([np.bincount(slot, (of_word[:, c] * scale)[owner], SLOTS) for c in range(k)], axis=1) - RIDGE * len(chains) * field.grams,
            lex.T @ of_word - RIDGE * field.lex, moved - expected - RIDGE * field.moves, miss[:, 0].sum(0) - RIDGE * field.start,
        )
        for x, g, s in zip((field.grams, field.lex, field.moves, field.start), slopes, sums):
            s += g**2
            x += (RATE * g / np.sqrt(s)).astype(x.dtype)
    return field


def posterior_means(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray, start: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Mean word posterior (documents, k) of chains that lie one after another in ``scores``; ``sizes`` are positive."""
    return _posteriors(scores, sizes, moves, start, block)[0]


def _posteriors(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray, start: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The means of ``posterior_means``, and the posteriors (words, k) themselves."""
    k, a = scores.shape[1], np.exp(moves)
    blocks = -(-sizes // block)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    nb = int(blocks.sum())
    place = np.arange(len(scores)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    row = np.repeat(first, sizes) + place // block
    col = place % block
    psi, here = np.ones((block, nb, k)), np.zeros((block, nb, 1), bool)
    psi[col, row] = np.exp(scores - scores.max(1, keepdims=True))
    here[col, row] = True
    opens = np.zeros((nb, 1), bool)
    opens[first] = True
    # transfer matrix of each block
    through = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for t in range(block):
        step = through if t == 0 else (through.reshape(-1, k) @ a).reshape(nb, k, k)
        if t == 0:
            step = np.where(opens[:, :, None], step, (through.reshape(-1, k) @ a).reshape(nb, k, k))
        step = step * psi[t][:, None, :]
        step /= step.max((1, 2), keepdims=True)
        through = np.where(here[t][:, :, None], step, through)
    # messages into each block from both sides, along the blocks of all documents at once
    into, back = np.ones((nb, k)), np.ones((nb, k))
    into[first] = np.exp(start - start.max())
    for i in range(1, int(blocks.max())):
        at = first[blocks > i] + i
        m = np.einsum("nk,nkj->nj", into[at - 1], through[at - 1])
        into[at] = m / m.sum(1, keepdims=True)
    for i in range(int(blocks.max()) - 1, 0, -1):
        at = first[blocks > i] + i
        m = np.einsum("nkj,nj->nk", through[at], back[at])
        back[at - 1] = m / m.sum(1, keepdims=True)
    alpha, now = np.empty((block, nb, k)), into
    for t in range(block):
        m = (np.where(opens, now, now @ a) if t == 0 else now @ a) * psi[t]
        now = np.where(here[t], m / m.sum(1, keepdims=True), now)
        alpha[t] = now
    total, now = np.zeros((nb, k)), back
    for t in range(block - 1, -1, -1):
        p = alpha[t] * now
        alpha[t] = p / p.sum(1, keepdims=True)
        total += np.where(here[t], alpha[t], 0)
        m = (psi[t] * now) @ a.T
        now = np.where(here[t], m / m.sum(1, keepdims=True), now)
    return np.add.reduceat(total, first, axis=0) / sizes[:, None], alpha[col, row]


class Scorer:
    """Means of the word posteriors for batches of texts, with the emissions of known words kept."""

    def __init__(self, field: Field):
        self.field, self.ids, self.table = field, {}, np.zeros((0, len(field.langs)))

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(posterior means, whether the text has a letter) of the texts."""
        return self.scored(texts)[:2]

    def scored(self, texts: list, words: bool = False) -> tuple:
        """(posterior means, whether the text has a letter, mean of each word's largest posterior, labels) of the texts.

        ``labels`` has the posteriors (words, k) of each text, None where it has no letter or ``words`` isn't set.
        """
        k = len(self.field.langs)
        out, has = np.zeros((len(texts), k)), np.zeros(len(texts), bool)
        sure, labels = np.zeros(len(texts)), [None] * len(texts)

        def put(some: list[int], held: list[list[str]]) -> None:
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            out[some], each = self._score(held, sizes)
            begins = np.cumsum(sizes) - sizes
            has[some], sure[some] = True, np.add.reduceat(each.max(1), begins) / sizes
            if words:
                for i, part in zip(some, np.split(each, begins[1:])):
                    labels[i] = part

        some, held, n = [], [], 0
        for i, text in enumerate(texts):
            words = words_of(text)
            if words and not all(map(str.isalpha, set(words))):  # numerals that are no digits
                words = [w for w in words if any(map(str.isalpha, w))]
            if words:
                some.append(i), held.append(words)
                n += len(words)
            if held and (n >= AT_ONCE * 16 // max(16, k * k) or i == len(texts) - 1):  # transfer matrices have k x k numbers
                put(some, held)
                some, held, n = [], [], 0
        if held:
            put(some, held)
        return out, has, sure, labels

    def _score(self, held: list[list[str]], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) > KNOWN:
            self.ids, self.table = {}, self.table[:0]
        ids, fresh = [], []
        known = self.ids
        for words in held:
            for w in words:
                i = known.get(w)
                if i is None:
                    i = known[w] = len(known)
                    fresh.append(w)
                ids.append(i)
        if fresh:
            self.table = np.concatenate([self.table, self.field.emissions(fresh)])
        return _posteriors(self.table[np.array(ids, np.int64)], sizes, self.field.moves, self.field.start)


def train(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", per_lang: int = SAMPLE, most_langs: int = LANGS) -> Field | None:
    """Fits the field on labelled rows of ``docs``; a row gives one segment of its words, at a place set by its id.

    The sample is bounded by ``per_lang`` documents a language, ``MOST`` in all (one a language at least) and ``most_langs``
    languages; a field of k languages takes time and memory by k x k.
    """
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("key"), F.col(lang_col).alias("lang"), "text")
    # A column of dirty labels may hold any number of values: the most frequent ones are learned.
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    per_lang = min(per_lang, max(1, MOST // max(1, len(sizes))))
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1_000_000, 1_000_000 * per_lang // r["n"])) for r in sizes], f"of {dict(docs.dtypes)[lang_col]}, share long")
    chosen = labelled.join(F.broadcast(share), F.col("lang") == F.col("of")).where(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1_000_000)) < F.col("share"))

    def segments(batches):
        for pdf in batches:
            rows = []
            for key, lang, text in zip(pdf["key"], pdf["lang"], pdf["text"]):
                words = words_of(text)
                begin = hash_of(key) % max(1, len(words) - 2 * SEGMENT + 1)
                rows.append((str(key), lang, " ".join(words[begin : begin + 2 * SEGMENT])))
            yield pd.DataFrame(rows, columns=["key", "lang", "text"])

    rows = chosen.select("key", "lang", "text").mapInPandas(segments, "key string, lang string, text string").groupBy("key", "lang").agg(F.min("text").alias("text")).toPandas()
    rows = rows.sort_values(["key", "lang", "text"])
    return fit([(lang, text.split()[i : i + SEGMENT]) for lang, text in zip(rows["lang"], rows["text"]) for i in (0, SEGMENT)])


def hash_of(key) -> int:
    """A number from the id that is the same in every run."""
    return int(np.frombuffer(hashlib.blake2b(str(key).encode(), digest_size=4).digest(), "<u4")[0])


SPANS = "array<struct<first:int,last:int,lang:string,posterior:double>>"


def spans_of(post: np.ndarray, langs: list[str]) -> list[tuple[int, int, str, float]]:
    """Runs of words whose largest posterior names one language: first and last word, language, mean posterior."""
    label, top = post.argmax(1), post.max(1)
    begins = np.concatenate([[0], np.nonzero(np.diff(label))[0] + 1])
    ends = np.append(begins[1:], len(label))
    means = np.add.reduceat(top, begins) / (ends - begins)
    return [(int(a), int(b) - 1, langs[label[a]], float(min(1.0, m))) for a, b, m in zip(begins, ends, means)]


def identify(docs: DataFrame, field: Field | None, id_col: str = "doc_id", spans: bool = False) -> DataFrame:
    """Per row of ``docs``: ``id_col``, lang_pred, score, shares (mean posterior by language); if asked, ``spans``.

    ``spans`` are the runs of words of one language: first and last of the words with a letter, language, mean posterior.

    Texts that are null or have no letter get ``und`` and score 0, as all do without a field. Ties go to the first
    language by name. Repeated rows each get their row; other columns are not read.
    """
    cols = docs.select(as_key(id_col), "text")

    def run(batches):
        score = Scorer(field) if field else None
        for pdf in batches:
            langs, scores, shares, runs = ["und"] * len(pdf), np.zeros(len(pdf)), [{}] * len(pdf), [[]] * len(pdf)
            if score:
                mean, has, _, labels = score.scored(list(pdf["text"]), spans)
                best = mean.argmax(1)
                langs = [field.langs[b] if h else "und" for b, h in zip(best, has)]
                scores = np.where(has, np.clip(mean.max(1), 0, 1), 0.0)
                shares = [dict(zip(field.langs, map(float, m))) if h else {} for m, h in zip(mean, has)]
                runs = [[] if post is None else spans_of(post, field.langs) for post in labels] if spans else runs
            out = pd.DataFrame({"key": pdf["key"], "lang_pred": langs, "score": scores, "shares": shares})
            yield out.assign(spans=runs) if spans else out

    kinds = "key string, lang_pred string, score double, shares map<string,double>" + (f", spans {SPANS}" if spans else "")
    return from_key(cols.mapInPandas(run, kinds), docs, id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_remainder(F.col("doc_id"), 3) == 1
    field = train(docs.where(~held_out))
    return identify(docs, field).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, field: Field | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose words are in known languages, with all their columns.

    The mean of each word's largest posterior is ``least`` at least: a text may switch between languages as often as it
    likes. Without a field nothing can be rejected for its score: the texts without a letter go.
    """

    def run(batches):
        score = Scorer(field) if field else None
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            if score:
                _, has, sure, _ = score.scored(texts)
                has &= sure >= least
            else:
                has = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
            yield batch.filter(pa.array(has))

    return docs.mapInArrow(run, docs.schema)
