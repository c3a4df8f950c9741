"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's features are the hashed byte n-grams of the word between boundary marks; its vector is the mean of theirs, the
text's vector the mean of its words'. Misspelt and inflected words share n-grams with the words that training has seen. As
the softmax is linear, a text's log-odds are the mean of those of its words, and these of their n-grams: scoring reads one
table of log-odds and never builds vectors.
A few words in a long text would vanish in its mean. So a text is scored by windows of `window` words (half overlapping), the
largest counts; training first takes whole texts, then, in rounds, of each toxic text the window that now scores highest,
of each clean text likewise (multiple-instance learning).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm import common as C

#: Sizes of n-grams in bytes, hash buckets, dimensions, words of a window.
SIZES, BUCKETS, DIMENSIONS, WINDOW = (3, 4, 5), 1 << 18, 4, 24
#: The sample that is learnt from: labelled rows of each class at most, bytes of one text at most, bytes of all of them at most.
MOST_ROWS, LONGEST, MOST_BYTES = 2000, 1 << 16, 1 << 24
_SCALE = 8.0


@dataclass(frozen=True)
class Features:
    """Of a batch of texts: n-gram buckets in text order, words' ends in them, texts' ends in words; where its text last had a word, or -1."""

    grams: np.ndarray
    word_ends: np.ndarray
    text_ends: np.ndarray
    before: np.ndarray


def features(texts: list[str]) -> Features:
    """Words are runs of bytes other than blanks; case is folded. A word shorter than an n-gram gives the ones that fit with its marks."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    buf = np.frombuffer(b" " + b"".join(x + b" " for x in raw), np.uint8).copy()
    buf[C.SPACE[buf]] = 0x20
    ends = np.cumsum([len(x) + 1 for x in raw]) + 1
    starts, stops = C.word_spans(buf)
    h, (_, down) = C.prefix_hash(buf), C.POWERS.to(len(buf) + 1)
    length = stops - starts + 2  # with both marks
    # a word said again within a window counts once: its repetition is no evidence
    word_hash = (h[stops] - h[starts]) * down[starts]
    by_word = np.argsort(word_hash, kind="stable")
    before = np.full(len(starts), -1)
    text_of = np.searchsorted(ends, starts, side="right")[by_word]
    again = (word_hash[by_word][1:] == word_hash[by_word][:-1]) & (text_of[1:] == text_of[:-1])
    before[by_word[1:][again]] = by_word[:-1][again]
    grams, owner = [], []
    for n in SIZES:
        # the n-grams of each word begin at its left mark and after
        count = np.maximum(length - n + 1, 0) if n > SIZES[0] else np.maximum(length - n + 1, 1)
        word = np.repeat(np.arange(len(starts)), count)
        i = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + starts[word] - 1
        j = np.minimum(i + n, stops[word] + 1)
        x = C.mix((h[j] - h[i]) * down[i] + np.uint64(n))
        grams.append((x & np.uint64(BUCKETS - 1)).astype(np.int32))
        owner.append(word)
    owner_all = np.concatenate(owner) if owner else np.zeros(0, int)
    order = np.argsort(owner_all, kind="stable")
    grams_all = np.concatenate(grams)[order]
    return Features(grams_all, np.cumsum(np.bincount(owner_all, minlength=len(starts))), np.searchsorted(starts, ends), before)


def _means(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    begins = np.concatenate(([0], ends[:-1]))
    return (total[ends] - total[begins]) / np.maximum(ends - begins, 1)


@dataclass
class Model:
    """gram_odds: what each bucket adds to a word's log-odds (over the word's n-grams); bias: of every window; empty: the score of a text without words."""

    gram_odds: np.ndarray
    bias: float
    window: int = WINDOW
    empty: float = 0.0

    def word_odds(self, f: Features) -> np.ndarray:
        return _means(self.gram_odds[f.grams], f.word_ends) if len(f.word_ends) else np.zeros(0)

    def best_windows(self, f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the log-odds of its highest window (the first of equal ones), and that window's first and last word."""
        word = self.word_odds(f)
        begins = np.concatenate(([0], f.text_ends[:-1])).astype(np.int64)
        ends = f.text_ends.astype(np.int64)
        step = self.window // 2
        count = np.maximum(-(-(ends - begins - self.window) // step), 0) + 1
        text = np.repeat(np.arange(len(ends)), count)
        a = begins[text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step
        b = np.minimum(a + self.window, ends[text])
        odds = np.zeros(len(a))
        if len(word):
            at = a[:, None] + np.arange(self.window)
            inside = np.minimum(at, len(word) - 1)
            odds = np.where((at < b[:, None]) & (f.before[inside] < a[:, None]), word[inside], 0).sum(1) / np.maximum(b - a, self.window // 2)
        order = np.lexsort((-odds, text))
        first = order[np.concatenate(([True], text[order][1:] != text[order][:-1]))] if len(order) else order
        return odds[first] * _SCALE + self.bias, a[first], b[first]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Of each text the probability of being toxic; for one without words the share of toxic labels."""
        f = features(texts)
        odds = self.best_windows(f)[0]
        return np.where(np.diff(f.text_ends, prepend=0) > 0, 1 / (1 + np.exp(-np.clip(odds, -500, 500))), self.empty)


def _bags(f: Features, a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and weights of each text's part from word a to word b."""
    begins = np.concatenate(([0], f.word_ends[:-1]))
    per_word = f.word_ends - begins
    out = []
    for i, j in zip(a, b):
        lo, hi = (begins[i], f.word_ends[j - 1]) if j > i else (0, 0)
        w = np.repeat((f.before[i:j] < i) / per_word[i:j], per_word[i:j]) * (_SCALE / max(j - i, least))
        u, inverse = np.unique(f.grams[lo:hi], return_inverse=True)
        out.append((u, np.bincount(inverse, w, len(u)).astype(np.float32)))
    return out


def train(texts: list[str], labels: list[int], dimensions: int = DIMENSIONS, window: int = WINDOW, rounds: int = 6, passes: int = 2, rate: float = 0.03, decay: float = 1e-5, seed: int = 3) -> Model:
    """Embeddings (buckets x dimensions, from zero) and a two-class softmax on them, by Adam on mini-batches.

    Each round adds the clean texts' highest windows to those of earlier rounds, so what once misled the model stays in view.
    """
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        share = (sum(labels) + 0.5) / (len(labels) + 1)
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))), window)
    rng = np.random.default_rng(seed)
    vectors = np.zeros((BUCKETS, dimensions), np.float32)  # an n-gram that was never seen says nothing
    out = rng.standard_normal((dimensions, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (vectors, out, bias)]
    model, step = Model(np.zeros(BUCKETS), 0.0, window), 0
    parts = [features(texts[lo:hi]) for lo, hi in C.slices([len(t) for t in texts], 1 << 19)]
    clean: list[tuple[np.ndarray, np.ndarray]] = []
    for r in range(rounds):
        bags = []
        for f in parts:
            a, b = (np.concatenate(([0], f.text_ends[:-1])), f.text_ends) if r == 0 else model.best_windows(f)[1:]
            bags += _bags(f, a, b, window // 2)
        toxic = [x for x, k in zip(bags, y) if k]
        clean = [x for x, k in zip(bags, y) if not k] + (clean if r > 1 else [])
        data = toxic + clean
        of = np.repeat([1, 0], [len(toxic), len(clean)])
        balance = np.where(of == 1, 0.5 / of.mean(), 0.5 / (1 - of.mean())).astype(np.float32)
        n_batches = max(1, len(of) // 64)
        for _ in range(max(passes, -(-120 // n_batches))):  # few rows are gone over more often
            for batch in np.array_split(rng.permutation(len(of)), n_batches):
                grams, w = (np.concatenate([data[i][k] for i in batch]) for k in (0, 1))
                row = np.repeat(np.arange(len(batch)), [len(data[i][0]) for i in batch])
                u, local = np.unique(grams, return_inverse=True)
                e = vectors[u]
                bag = np.stack([np.bincount(row, w * e[local, d], len(batch)) for d in range(dimensions)], 1).astype(np.float32)
                logits = bag @ out + bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(batch)), of[batch]] -= 1
                p *= balance[batch, None]
                back = p @ out.T
                ge = np.stack([np.bincount(local, w * back[row, d], len(u)) for d in range(dimensions)], 1).astype(np.float32)
                step += 1
                for param, (m, v), rows, g in zip((vectors, out, bias), moments, (u, slice(None), slice(None)), (ge, bag.T @ p, p.sum(0))):
                    m[rows] += 0.1 * (g - m[rows])
                    v[rows] += 0.01 * (g * g - v[rows])
                    param[rows] -= rate * m[rows] / (np.sqrt(v[rows]) + 0.02) + decay * param[rows]
        model = Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]), window)
    return model


def learnable(doc_id: Column) -> Column:
    """Labels may be learnt from rows whose crc32(doc_id as text) mod 4 is not 2."""
    return F.crc32(doc_id.cast("string")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, may_learn: Column | None = None, longest: int = LONGEST, most_bytes: int = MOST_BYTES) -> Model:
    """A model from a bounded sample of labelled documents, trained in one task of an executor; the driver gets the model's table only.

    At most most_rows of each class (those with the lowest hashes of doc_id), no text of more than `longest` bytes, and of these as many,
    in the order of the hashes, as fit in most_bytes; the model learns from whole texts. Rows without a label, a doc_id or a text are not
    learnt from. Repeated labels of an id count once, the larger one; rows that repeat a doc_id are texts each, within the bounds. With
    no rows, or those of one class only, every text has the same score: the share of toxic labels (0 without labels).
    """
    own = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.where(learnable(F.col("doc_id")) if may_learn is None else may_learn)
    by_hash = F.xxhash64("doc_id")
    pick = [own.where(f"toxic = {k}").orderBy(by_hash, "doc_id").limit(most_rows) for k in (0, 1)]
    chosen = C.cut(pick[0].unionByName(pick[1]))
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    rows = rows.select(by_hash.alias("h"), "doc_id", "text", "toxic").orderBy("h", "doc_id", "text").limit(2 * most_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic, total = [], [], 0
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total += len(text.encode())
                if total <= most_bytes:
                    texts.append(text)
                    toxic.append(label)
        model = train(texts, toxic)
        yield pa.RecordBatch.from_arrays([pa.array([model.gram_odds.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias])], ["odds", "bias"])

    found = rows.select("text", "toxic").mapInArrow(learn, "odds binary, bias double").collect()  # one row of 4 * BUCKETS bytes
    share = float(own.agg(F.avg("toxic")).first()[0] or 0.0)
    if not found or not np.frombuffer(found[0].odds, "<f4").any():
        part = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), float(np.log(part / (1 - part))), empty=share)
    return Model(np.frombuffer(found[0].odds, "<f4"), found[0].bias, empty=share)


def _judged(docs: DataFrame, model: Model, schema: str | StructType, place: int, out: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """docs in batches of bounded size, each with the scores of its texts (column number place)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.gram_odds.astype(np.float32), model.bias, model.window, model.empty))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [t or "" for t in batch.column(place).to_pylist()]
                found = np.zeros(len(texts))
                for lo, hi in C.slices([len(t) for t in texts], 1 << 19):
                    found[lo:hi] = own.scores(texts[lo:hi])
                yield out(batch, found)

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of docs(doc_id, text), repeated rows included; other columns, whatever their names, are not read.

    Null text counts as empty; empty and blank texts have the score model.empty. Of a long text every window is scored. A null doc_id
    is kept. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _judged(rows, model, "doc_id long, score double", 1, lambda batch, found: pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"]))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below the threshold, all columns; one that scores the threshold itself goes.

    Rows are judged by their own text, whatever their id; texts count as in score(). An empty table gives no rows.
    """
    return _judged(docs, model, docs.schema, docs.columns.index("text"), lambda batch, found: batch.filter(pa.array(found < threshold)))
