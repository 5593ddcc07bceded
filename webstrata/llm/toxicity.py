"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (with word marks) and
of the word itself; a window of words is the mean of its words, and a linear
softmax reads it. Vectors and softmax are learned together. Misspellings never
seen share most n-grams, and so most of the vector, with the word they hide.

A document says what its most toxic window says: learning starts from averages
over whole documents and goes on with the strongest window of each, and a
logistic map turns that window's value into the document's score. It is fitted
with numpy on the driver, on at most ``sample`` labelled documents of at most
``sample_chars`` characters, whatever the corpus size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from webstrata.llm.shared import crc_mod, labelled_sample

MODULUS, HELD_OUT = 4, 2
THRESHOLD = 0.3
SAMPLE, SAMPLE_CHARS = 6000, 8_000
GRAMS, BUCKET_BITS, WIDTH = (3, 4, 5), 18, 8
BUCKETS = 1 << BUCKET_BITS
#: n-grams whose documents lean less to a label have no vector of their own.
LEAST_LEAN = 15.0
WINDOW, STRIDE = 8, 4
#: Share of a word's n-gram sum that a misspelling is taken to keep.
MISSPELT_SHARE = 0.35
AVERAGE_STEPS, WINDOW_STEPS, RATE, DECAY = 40, 160, 0.05, 2e-5
#: Words whose values a task remembers, and documents that it takes at once.
CACHE_WORDS, BATCH = 300_000, 256
#: Longer words are split, so that one word's n-grams stay few.
WORD_CHARS = 40

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W_]{1,%d}" % WORD_CHARS)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of its word) of all n-grams of the marked words, and of the words.

    Hashes are polynomials of code points, computed for all words at once.
    """
    marked = [f"<{w}>" for w in words]
    size = np.array([len(m) for m in marked], np.int64)
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), size)
    stop = np.cumsum(size)
    left = stop[owner] - np.arange(len(codes))  # characters of the word from here on
    hashes, owners = [], []
    for n in GRAMS:
        if len(codes) >= n:
            value = np.full(len(codes) - n + 1, n, np.uint64)
            for i in range(n):
                value = value * _PRIME + codes[i:len(codes) - n + 1 + i]
            whole = left[:len(value)] >= n
            hashes.append(value[whole])
            owners.append(owner[:len(value)][whole])
    if len(words):
        place = np.arange(len(codes)) - (stop - size)[owner]
        power = np.cumprod(np.full(WORD_CHARS + 3, _PRIME, np.uint64))
        hashes.append(np.add.reduceat(codes * power[place], stop - size))
        owners.append(np.arange(len(words), dtype=np.int32))
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    value = np.concatenate(hashes)
    value = (value ^ (value >> np.uint64(31))) * _PRIME
    return (value >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.concatenate(owners)


def word_values(words: list[str], values: np.ndarray) -> np.ndarray:
    """Mean value of each word's buckets."""
    bucket, owner = grams_of(words)
    count = np.bincount(owner, minlength=len(words))
    return np.bincount(owner, values[bucket], len(words)) / np.maximum(count, 1)


def windows(count: int) -> np.ndarray:
    """First words of the windows over ``count`` words; the last one ends the text."""
    if count <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, count - WINDOW + 1, STRIDE)
    return starts if starts[-1] == count - WINDOW else np.r_[starts, count - WINDOW]


@dataclass
class Model:
    values: np.ndarray  # per bucket: its vector times the softmax's class difference
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    prior: float = 0.5
    vectors: np.ndarray | None = None
    softmax: np.ndarray | None = None

    def score(self, words: list[str], known: dict[str, float]) -> float:
        if self.scale == 0.0 or not words:
            return self.prior
        found = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        sums = np.r_[0.0, np.cumsum(found)]
        start = windows(len(words))
        end = np.minimum(start + WINDOW, len(words))
        best = ((sums[end] - sums[start]) / (end - start)).max() + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.scale * best + self.shift, -30, 30))))

    def scores(self, texts: list[str | None], known: dict[str, float]) -> list[float]:
        """Scores; ``known`` keeps word values from call to call."""
        out: list[float] = []
        for low in range(0, len(texts), BATCH):
            bags = [words_of(t) for t in texts[low:low + BATCH]]
            own = set().union(*bags)
            if len(known) + len(own) > CACHE_WORDS:
                known.clear()
            new = list(own.difference(known))
            known.update(zip(new, word_values(new, self.values).tolist(), strict=True))
            out += [self.score(bag, known) for bag in bags]
        return out


def lean(toxic: np.ndarray, having: np.ndarray, prior: float) -> np.ndarray:
    """How much the documents of a bucket lean to a label: twice the log
    likelihood ratio between their own share of toxic ones and everyone's."""
    share = np.clip(toxic / np.maximum(having, 1), 1e-12, 1 - 1e-12)
    gain = share * np.log(share / prior) + (1 - share) * np.log((1 - share) / (1 - prior))
    return 2 * having * gain


def logistic(x: np.ndarray, y: np.ndarray, pull: float = 0.1) -> tuple[float, float]:
    """(scale, shift) of a logistic map, by Newton steps."""
    scale, shift = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(scale * x + shift, -30, 30)))
        g = np.array([((y - p) * x).sum() - pull * (scale - 1), (y - p).sum() - pull * shift])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + pull, (w * x).sum()], [(w * x).sum(), w.sum() + pull]])
        move = np.linalg.solve(h, g)
        size = max(1.0, float(np.abs(move).max()))
        scale, shift = max(scale + move[0] / size, 0.05), shift + move[1] / size
        if abs(move).max() < 1e-9:
            break
    return float(scale), float(shift)


def fit(texts: list[str], labels: list[int], seed: int = 0) -> Model:
    """The model of labelled documents (1: toxic).

    Without documents every score is 0.5, with one label only it is 0 or 1.
    """
    wanted = np.array(labels, np.float64)
    prior = float(wanted.mean()) if len(wanted) else 0.5
    index: dict[str, int] = {}
    bags = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int32) for t in texts]
    counts = np.array([len(b) for b in bags], np.int64)
    if not counts.sum() or prior in (0.0, 1.0):
        return Model(np.zeros(BUCKETS), scale=0.0, prior=prior)
    flat, of_word = grams_of(list(index))
    size = np.bincount(of_word, minlength=len(index))
    tokens = np.concatenate(bags)
    # Only buckets whose documents lean to one label learn; the others would
    # learn the documents by heart and stay zero.
    order = np.argsort(of_word, kind="stable")
    flat, of_word = flat[order], of_word[order]
    begin = np.r_[0, np.cumsum(size)]
    having, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bag, label in zip(bags, wanted, strict=True):
        if len(bag):
            own = np.unique(np.concatenate([flat[begin[i]:begin[i + 1]] for i in np.unique(bag)]))
            having[own] += 1
            toxic[own] += label
    learns = lean(toxic, having, prior) >= LEAST_LEAN
    kept, learners = learns[flat], np.flatnonzero(learns)
    flat, of_word = np.searchsorted(learners, flat[kept]), of_word[kept]
    del index, bags, order
    offset = np.r_[0, np.cumsum(counts)[:-1]]
    full = np.flatnonzero(counts > 0)
    starts = [windows(counts[i]) + offset[i] for i in full]
    doc_of = np.repeat(np.arange(len(full)), [len(s) for s in starts])
    start = np.concatenate(starts)
    end = np.minimum(start + WINDOW, (offset + counts)[full][doc_of])
    whole = (offset[full], (offset + counts)[full])
    y = wanted[full]
    # Both labels weigh the same in learning; the logistic map restores their shares.
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)

    random = np.random.default_rng(seed)
    vectors = random.normal(0, 0.1, (len(learners), WIDTH))
    softmax, bias = random.normal(0, 0.5, (2, WIDTH)), np.zeros(2)
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    step = 0

    def adam(name: str, value: np.ndarray, slope: np.ndarray) -> None:
        m, v = moments.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (slope - m)
        v += 0.001 * (slope**2 - v)
        value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def values() -> np.ndarray:
        return vectors @ (softmax[1] - softmax[0])

    def word_means(per_bucket: np.ndarray) -> np.ndarray:
        return np.bincount(of_word, per_bucket[flat], len(size)) / size

    for turn in range(AVERAGE_STEPS + WINDOW_STEPS):
        step += 1
        per_word = word_means(values())
        sums = np.r_[0.0, np.cumsum(per_word[tokens])]
        low, high = whole
        if turn >= AVERAGE_STEPS:
            means = (sums[end] - sums[start]) / (end - start)
            order = np.lexsort((-means, doc_of))
            best = order[np.r_[True, doc_of[order][1:] != doc_of[order][:-1]]]
            low, high = start[best], end[best]
        logit = (sums[high] - sums[low]) / (high - low) + bias[1] - bias[0]
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight
        # Error of every occurrence in the chosen windows, then of every word and bucket.
        lines = np.zeros(len(tokens) + 1)
        np.add.at(lines, low, error / (high - low))
        np.add.at(lines, high, -error / (high - low))
        of_token = np.cumsum(lines)[:-1]
        g_word = np.bincount(tokens, of_token, len(size)) / size
        g_bucket = np.bincount(flat, g_word[of_word], len(learners))
        difference = softmax[1] - softmax[0]
        g_softmax = g_bucket @ vectors
        adam("vectors", vectors, np.outer(g_bucket, difference) + DECAY * vectors)
        adam("softmax", softmax, np.stack([-g_softmax, g_softmax]) + DECAY * softmax)
        adam("bias", bias, np.array([-error.sum(), error.sum()]))
    every = np.zeros(BUCKETS)
    every[learners] = values()
    model = Model(every, float(bias[1] - bias[0]), 1.0, 0.0, prior, vectors, softmax)
    per_word = word_means(values())
    sums = np.r_[0.0, np.cumsum(per_word[tokens])]
    best = np.full(len(full), -np.inf)
    np.maximum.at(best, doc_of, (sums[end] - sums[start]) / (end - start))
    # A misspelt word keeps part of its n-grams: toxic documents count once more, weakened.
    weak = best[y == 1] * MISSPELT_SHARE
    model.scale, model.shift = logistic(
        np.r_[best, weak] + model.bias, np.r_[y, np.ones(len(weak))]
    )
    return model


def scorer(spark, model: Model):
    """Column function: text to score. The model, of a fixed size, is broadcast."""
    shared = spark.sparkContext.broadcast(
        Model(model.values.astype(np.float32), model.bias, model.scale, model.shift, model.prior)
    )

    @pandas_udf(DoubleType())
    def toxicity_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist(), known), dtype="float64")

    return lambda text: toxicity_score(text)


def learn(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS,
) -> Model:
    rows = labelled_sample(documents, labels, MODULUS, HELD_OUT, sample, sample_chars, id_col, text_col, label_col)
    return fit([t.decode("utf-8", "replace") for _, t, _ in rows], [int(label > 0) for _, _, label in rows])


def assess(
    documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
    text_col: str = "text", **options,
) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    NULL and empty texts, and texts without a word, get the learning documents'
    mean label as score. A NULL id counts as held out. Repeated rows get equal
    scores; an empty table gives an empty table. Only id and text are read.
    """
    score = scorer(documents.sparkSession, learn(documents, labels, id_col, text_col, **options))
    id_ = documents[id_col]
    scored = documents.select(
        id_.alias(id_col), F.coalesce(crc_mod(id_, MODULUS) == HELD_OUT, F.lit(True)).alias("held_out"),
        score(documents[text_col]).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
