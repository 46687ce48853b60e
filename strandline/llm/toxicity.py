"""Toxicity: a convolutional text classifier in numpy, calibrated by language.

A word is the sum of hashed embeddings of itself and of its leading letters (which carry
inflected forms), each looked up in two tables so that a collision in one does not decide. Filters of
several widths slide over the whole text, each filter keeps its maximum, and a linear layer
scores the pooled vector. Training (``fit``) runs on the driver over a bounded sample of labelled rows:
at most ``MAX_SAMPLE`` rows and ``MAX_SAMPLE_CHARS`` characters, taken by the hash of their ids. Embeddings start from the log
odds of their buckets, so that the filters have something to find, and move by plain gradient steps; the other layers are trained by Adam.

Thresholds are calibrated by language on a part of the sample that is not trained on. The
language is never read from the row: a second hashed table, learned from the same sample, guesses it from the
words, and the logit is shifted so that the threshold of the guessed language falls on ``THRESHOLD``.

Edge cases: a null or empty text, or one without words, gets the lowest score the model can give; the
same text always gets the same score; labels that are null or of unknown documents are not learned from; without any
usable label no text reaches the threshold; an empty table gives no rows. Other columns are carried along by
name, except one named as the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table

THRESHOLD = 0.7
MAX_SAMPLE, MAX_SAMPLE_CHARS = 4000, 16_000_000
BUCKETS, DIM = 1 << 17, 6
PREFIX = 5
WIDTHS, FILTERS = (1, 2, 3), 8
EPOCHS, BATCH_DOCS, RATE = 6, 64, 0.01
CACHE_WORDS = 300_000
CHUNK_WORDS = 65_536
WORD = re.compile(r"\w+")
FEATURES = 4  # word and prefix, in two tables each


class WordIds(dict):
    """The four buckets of a word; bounded, since it only saves time."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        own, head = word.encode(), b"^" + word[:PREFIX].encode()
        ids = [zlib.crc32(x, salt) % BUCKETS + t * BUCKETS for t, salt in ((0, 0), (1, 7)) for x in (own, head)]
        self[word] = out = np.array(ids, np.int32).tobytes()
        return out


def buckets(text: str | None, ids: WordIds) -> np.ndarray:
    """(words, FEATURES): the buckets of every word of a text."""
    words = WORD.findall((text or "").lower())
    return np.frombuffer(b"".join(map(ids.__getitem__, words)), np.int32).reshape(-1, FEATURES)


class Model:
    """The trained arrays; ``logits`` scores whole texts."""

    def __init__(self, emb, kernels, biases, out, bias, lang_table, shift, scale):
        self.emb, self.kernels, self.biases, self.out, self.bias = emb, kernels, biases, out, bias
        self.lang_table, self.shift, self.scale = lang_table, shift, scale

    def pooled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The maximum of every filter over a text and where it stands; the text is read in overlapping chunks."""
        best = np.full(len(WIDTHS) * FILTERS, 0.0, np.float32)
        where = np.full(len(best), -1, np.int64)
        for start in range(0, len(ids), CHUNK_WORDS):
            x = self.emb[ids[start : start + CHUNK_WORDS + WIDTHS[-1] - 1]].sum(axis=1)
            for j, width in enumerate(WIDTHS):
                n = min(len(x) - width + 1, CHUNK_WORDS)
                if n <= 0:
                    continue
                y = x[:n] @ self.kernels[j][0]
                for k in range(1, width):
                    y += x[k : k + n] @ self.kernels[j][k]
                y += self.biases[j]
                part, at = slice(j * FILTERS, (j + 1) * FILTERS), y.argmax(axis=0)
                top = y[at, np.arange(FILTERS)]
                more = top > best[part]
                where[part] = np.where(more, start + at, where[part])
                best[part] = np.where(more, top, best[part])
        return best, where

    def language(self, ids: np.ndarray) -> int:
        """The guessed language's number; the last one stands for texts without words."""
        n_langs = self.lang_table.shape[1]
        if not len(ids):
            return n_langs
        total = np.zeros(n_langs)
        for start in range(0, len(ids), CHUNK_WORDS):
            total += self.lang_table[ids[start : start + CHUNK_WORDS, 0]].sum(axis=0)
        return int(total.argmax())

    def score(self, ids: np.ndarray) -> float:
        logit = float(self.pooled(ids)[0] @ self.out + self.bias)
        z = self.scale * (logit - self.shift[self.language(ids)]) + np.log(THRESHOLD / (1 - THRESHOLD))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _log_odds(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = np.ones((2, 2 * BUCKETS)) * 0.5
    for ids, y in zip(docs, labels, strict=True):
        counts[int(y), np.unique(ids)] += 1
    n = np.bincount(labels.astype(int), minlength=2) + 1.0
    odds = np.log(counts[1] / n[1]) - np.log(counts[0] / n[0])
    return np.where(counts.sum(axis=0) > 3, np.clip(odds, -3, 6), 0.0)


def fit(texts: list[str], labels: list[int], langs: list[str | None], seed: int = 4) -> Model:
    """Train on a sample: three quarters for the layers, one quarter for the thresholds."""
    rng, ids = np.random.default_rng(seed), WordIds()
    names = sorted({x for x in langs if x is not None})
    docs, y = [buckets(t, ids) for t in texts], np.array(labels, np.float64)
    train = np.arange(len(docs)) % 4 != 3
    if not len(docs) or y[train].min(initial=1) == y[train].max(initial=0):
        return Model(np.zeros((2 * BUCKETS, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), 0.0, np.zeros((2 * BUCKETS, max(1, len(names)))), np.full(max(1, len(names)) + 1, 100.0), 1.0)
    own = np.flatnonzero(train)
    emb = rng.normal(0, 0.01, (2 * BUCKETS, DIM)).astype(np.float32)
    emb[:, 0] = _log_odds([docs[i] for i in own], y[own]) / FEATURES
    emb[emb[:, 0] == 0] = 0
    kernels = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for k in kernels:
        k[:, 0, :] = rng.uniform(0.2, 0.6, (len(k), FILTERS)) / len(k)
    biases = [np.full(FILTERS, -0.3, np.float32) for _ in WIDTHS]
    model = Model(emb, kernels, biases, np.full(len(WIDTHS) * FILTERS, 0.3, np.float32), -1.0, None, None, 1.0)
    _train(model, [docs[i] for i in own], y[own], rng)
    counts = np.full((2 * BUCKETS, max(1, len(names))), 0.1)
    for d, lang in zip(docs, langs, strict=True):
        if lang is not None and len(d):
            np.add.at(counts[:, names.index(lang)], d[:, 0], 1)
    model.lang_table = (np.log(counts / counts.sum(axis=0)) - np.log(counts / counts.sum(axis=0)).mean(axis=1, keepdims=True)).astype(np.float32)
    _calibrate(model, docs, y, train)
    return model


def _train(model: Model, docs: list[np.ndarray], y: np.ndarray, rng) -> None:
    """Adam over minibatches; only the words at the maxima get gradients."""
    dense = [*model.kernels, *model.biases, model.out]
    first, second = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    bias_m = bias_v = 0.0
    weight = np.where(y == 1, min(5.0, (len(y) - y.sum()) / max(1.0, y.sum())), 1.0)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for begin in range(0, len(order), BATCH_DOCS):
            step += 1
            grads, bias_g = [np.zeros_like(p) for p in dense], 0.0
            moved: dict[int, np.ndarray] = {}
            picked = order[begin : begin + BATCH_DOCS]
            for i in picked:
                pooled, where = model.pooled(docs[i])
                p = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.bias, -30, 30)))
                g = np.float32((p - y[i]) * weight[i] / len(picked))
                bias_g += float(g)
                grads[-1] += g * pooled
                down = g * model.out
                for j, width in enumerate(WIDTHS):
                    for f in range(FILTERS):
                        at, d = where[j * FILTERS + f], down[j * FILTERS + f]
                        if at < 0:
                            continue
                        grads[len(WIDTHS) + j][f] += d
                        for k in range(width):
                            rows = docs[i][at + k]
                            grads[j][k, :, f] += d * model.emb[rows].sum(axis=0)
                            for r in rows:
                                moved[r] = moved.get(r, 0) + d * model.kernels[j][k, :, f]
            for p, g, m, v in zip(dense, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            bias_m += 0.1 * (bias_g - bias_m)
            bias_v += 0.001 * (bias_g**2 - bias_v)
            model.bias -= RATE * (bias_m / (1 - 0.9**step)) / (np.sqrt(bias_v / (1 - 0.999**step)) + 1e-8)
            for r, g in moved.items():
                model.emb[r] -= 0.5 * g


def _calibrate(model: Model, docs: list[np.ndarray], y: np.ndarray, train: np.ndarray) -> None:
    """For each guessed language the threshold in the middle of the gap of best F1, over the rows not trained on."""
    held = np.flatnonzero(~train)
    logits = np.array([float(model.pooled(docs[i])[0] @ model.out + model.bias) for i in held])
    langs = np.array([model.language(docs[i]) for i in held])

    def threshold(z: np.ndarray, label: np.ndarray) -> float | None:
        if label.sum() < 3 or label.sum() == len(label):
            return None
        order = np.argsort(-z, kind="stable")
        hits = np.cumsum(label[order])
        f1 = 2 * hits / (np.arange(1, len(z) + 1) + label.sum())
        at = int(f1.argmax())
        below = z[order[at + 1]] if at + 1 < len(z) else z[order[at]] - 1
        return float((z[order[at]] + below) / 2)

    overall = threshold(logits, y[held])
    overall = 0.0 if overall is None else overall
    n_langs = model.lang_table.shape[1]
    found = [threshold(logits[langs == k], y[held][langs == k]) for k in range(n_langs)]
    model.shift = np.array([overall if t is None else t for t in found] + [overall])
    model.scale = 1.0


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_SAMPLE, max_chars: int = MAX_SAMPLE_CHARS) -> list[tuple]:
    """A bounded sample (id, text, label, lang) of labelled rows, by the hash of their ids; held-out rows never enter."""
    usable = labels.filter("toxic is not null and doc_id is not null").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = usable.count()
    share = min(1.0, 1.2 * max_rows / max(n, 1))
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    chosen = F.broadcast(chosen) if n * share <= 4 * max_rows else chosen
    rows = docs.select("doc_id", "text", "lang", F.length("text").alias("size")).join(chosen, "doc_id")
    order = [F.xxhash64("doc_id"), "text"]
    kept = Scratch(docs.sparkSession).keep(rows.orderBy(*order).limit(max_rows))
    chars = kept.agg(F.sum("size")).first()[0] or 0
    most = max_rows if chars <= max_chars else int(max_rows * max_chars / chars)  # an unusually long sample: fewer rows
    return [(r.doc_id, r.text, r.toxic, r.lang) for r in kept.orderBy(*order).limit(most).filter(F.col("size").isNotNull()).collect()]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _score(batches: Iterator[pa.RecordBatch], model, text_at: int, score_col: str) -> Iterator[pa.RecordBatch]:
    ids = WordIds()
    for batch in batches:
        scores = [model.value.score(buckets(t, ids)) for t in batch.column(text_at).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, score_col])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels)
    return fit([r[1] for r in rows], [int(r[2]) for r in rows], [r[3] for r in rows])


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with each row's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2 * BUCKETS rows of DIM and of the languages
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(lambda it: _score(it, shared, at, score_col), schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels)
    return with_score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
