"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its score reads the features of the line and of both
neighbours; a 2x2 table scores what follows what. Marginals come from the
forward-backward recursion, are weighted by line length and averaged, and a
logistic map fitted on the learning documents turns the average into the score.

The field is fitted on the driver with numpy, on at most ``sample`` labelled
documents of at most ``sample_chars`` characters each, whatever the corpus size.
Line labels start as the document's; then lines of bad documents that look good
are taken as good and the field is fitted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from webstrata.llm.shared import crc_mod, fresh, labelled_sample

MODULUS, HELD_OUT = 3, 1
SAMPLE, SAMPLE_CHARS = 6000, 8_000
THRESHOLD = 0.5
#: Cut points of each feature at these shares of the learning lines.
SHARES = (0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98)
ROUNDS, STEPS, RATE, DECAY = 2, 120, 0.15, 1e-3
#: Documents whose lines a task holds at once.
BATCH = 512

_CLASSES = tuple(x.encode() for x in (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*@^~=+_\\", "|<>{}[]/", "!?", ".,;:", "'\"()-", "aeiou",
))


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features per line, characters that are no white space per line)."""
    seen: dict[bytes, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    rows, sizes = [], []
    for line in lines:
        words = line.split()
        n, size = max(len(words), 1), sum(map(len, words))
        whole = max(size, 1)
        lengths = [*map(len, words)] or [0]
        rows.append((
            np.log1p(size), np.log1p(len(words)), size / n, max(lengths), len(set(words)) / n,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
            seen[line], 1.0 if line.rstrip()[-1:] in (b".", b"!", b"?") else 0.0,
            sum(x <= 3 for x in lengths) / n,
            *((len(line) - len(line.translate(None, chars))) / whole for chars in _CLASSES),
        ))
        sizes.append(size)
    width = 9 + len(_CLASSES)
    return np.array(rows, np.float64).reshape(-1, width), np.array(sizes, np.float64)


def lines_of(text: bytes | None) -> list[bytes]:
    return [x for x in (text or b"").split(b"\n") if x.strip()]


@dataclass
class Field:
    cuts: np.ndarray  # features x cut points
    weights: np.ndarray  # places (before, here, after) x features x bins
    steps: np.ndarray  # 2 x 2: from, to; 0 bad, 1 good
    scale: float = 1.0
    shift: float = 0.0
    prior: float = 0.5

    def bins(self, features: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(c, features[:, i], "right") for i, c in enumerate(self.cuts)]
        return np.stack(columns, axis=1) if len(features) else np.zeros((0, len(self.cuts)), np.int64)

    def emissions(self, bins: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Score of good against bad per line; lines of many documents in a row."""
        index = np.arange(self.weights.shape[1])
        before, here, after = (w[index, bins].sum(axis=1) for w in self.weights)
        out = here.copy()
        out[1:] += np.where(first[1:], 0, before[:-1])
        out[:-1] += np.where(last[:-1], 0, after[1:])
        return out


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(emission: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance of good per line, expected count of each step), by forward-backward.

    All documents advance together, line by line; they are ordered by length,
    so the ones still running are always the first ones.
    """
    order = np.argsort(-lengths, kind="stable")
    start = np.r_[0, np.cumsum(lengths)[:-1]][order]
    size = lengths[order]
    longest = int(size[0]) if len(size) else 0
    running = [int(np.searchsorted(-size, -t, "left")) for t in range(longest)]  # documents with more than t lines
    forward = np.zeros((len(emission), 2))
    backward = np.zeros((len(emission), 2))
    for t in range(longest):
        at = start[:running[t]] + t
        if t:
            held = forward[at - 1]
            forward[at, 0] = _log_sum(held[:, 0] + steps[0, 0], held[:, 1] + steps[1, 0])
            forward[at, 1] = _log_sum(held[:, 0] + steps[0, 1], held[:, 1] + steps[1, 1])
        forward[at, 1] += emission[at]
    for t in range(longest - 2, -1, -1):
        at = start[:running[t + 1]] + t
        bad, good = backward[at + 1, 0], backward[at + 1, 1] + emission[at + 1]
        backward[at, 0] = _log_sum(steps[0, 0] + bad, steps[0, 1] + good)
        backward[at, 1] = _log_sum(steps[1, 0] + bad, steps[1, 1] + good)
    both = forward + backward
    total = _log_sum(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    expected = np.zeros((2, 2))
    follows = np.ones(len(emission), bool)
    follows[np.r_[0, np.cumsum(lengths)[:-1]][lengths > 0]] = False
    to = np.flatnonzero(follows)
    for i in (0, 1):
        for j in (0, 1):
            score = forward[to - 1, i] + steps[i, j] + backward[to, j] + (emission[to] if j else 0) - total[to]
            expected[i, j] = np.exp(score).sum()
    return good, expected


def _ends(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = int(lengths.sum())
    first, last = np.zeros(total, bool), np.zeros(total, bool)
    some = lengths > 0
    stop = np.cumsum(lengths)
    first[(stop - lengths)[some]] = True
    last[stop[some] - 1] = True
    return first, last


def _weighted(good: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    owner = np.repeat(np.arange(len(lengths)), lengths)
    weight = np.bincount(owner, sizes, len(lengths))
    return np.bincount(owner, sizes * good, len(lengths)) / np.where(weight > 0, weight, 1)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(texts: list[bytes | None], labels: list[int]) -> Field:
    """The field of labelled documents (1: good).

    Without documents the score is 0.5 everywhere, with one label only it is
    that label's share, 0 or 1.
    """
    width = 9 + len(_CLASSES)
    wanted = np.array(labels, np.float64)
    prior = float(wanted.mean()) if len(wanted) else 0.5
    found = [line_features(lines_of(t)) for t in texts]
    lengths = np.array([len(s) for _, s in found], np.int64)
    if not lengths.sum() or prior in (0.0, 1.0):
        return Field(np.zeros((width, 0)), np.zeros((3, width, 1)), np.zeros((2, 2)), 0.0, _logit(np.array(prior)), prior)
    features = np.concatenate([f for f, _ in found])
    sizes = np.concatenate([s for _, s in found])
    cuts = np.quantile(features, SHARES, axis=0).T + 1e-9
    field = Field(cuts, np.zeros((3, width, len(SHARES) + 1)), np.zeros((2, 2)), prior=prior)
    bins, (first, last) = field.bins(features), _ends(lengths)
    flat = bins + np.arange(width) * (len(SHARES) + 1)
    of_line = np.repeat(wanted, lengths)
    target = of_line.copy()
    count, shape = len(target), field.weights.shape
    follows = np.flatnonzero(~first)

    def gather(error: np.ndarray, rows: np.ndarray) -> np.ndarray:
        weights = np.repeat(error, width)
        return np.bincount(flat[rows].ravel(), weights, shape[1] * shape[2]).reshape(shape[1:])

    for round_ in range(ROUNDS):
        moments = [np.zeros(shape), np.zeros(shape), np.zeros((2, 2)), np.zeros((2, 2))]
        pair = np.zeros((2, 2))
        np.add.at(pair, (target[follows - 1].astype(int), target[follows].astype(int)), 1)
        for step in range(1, STEPS + 1):
            good, expected = marginals(field.emissions(bins, first, last), lengths, field.steps)
            error = target - good
            here = gather(error, np.arange(count))
            before = gather(error[follows], follows - 1)
            after = gather(error[follows - 1], follows)
            slopes = (np.stack([before, here, after]) / count - DECAY * field.weights, (pair - expected) / count)
            for i, (value, slope) in enumerate(((field.weights, slopes[0]), (field.steps, slopes[1]))):
                m, v = moments[2 * i], moments[2 * i + 1]
                m += 0.1 * (slope - m)
                v += 0.01 * (slope**2 - v)
                value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        good, _ = marginals(field.emissions(bins, first, last), lengths, field.steps)
        if round_ + 1 < ROUNDS:
            # In a bad document the worst line stays bad, the ones that look good are good.
            owner = np.repeat(np.arange(len(lengths)), lengths)
            least = np.full(len(lengths), np.inf)
            np.minimum.at(least, owner, good)
            target = np.where((of_line == 0) & (good > 0.5) & (good > least[owner]), 1.0, of_line)
    x = _logit(_weighted(good, sizes, lengths))
    scale, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic map, slightly pulled to (1, 0)
        p = 1 / (1 + np.exp(-(scale * x + shift)))
        g = np.array([((wanted - p) * x).sum() - 0.1 * (scale - 1), (wanted - p).sum() - 0.1 * shift])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        move = np.linalg.solve(h, g)
        scale, shift = max(scale + move[0], 0.05), shift + move[1]
        if abs(move).max() < 1e-9:
            break
    field.scale, field.shift = float(scale), float(shift)
    return field


def score_texts(field: Field, texts: list[bytes | None]) -> np.ndarray:
    """Scores between 0 and 1; texts without a line get the learning documents' mean."""
    found = [line_features(lines_of(t)) for t in texts]
    lengths = np.array([len(s) for _, s in found], np.int64)
    out = np.full(len(texts), field.prior)
    if field.scale == 0.0 or not lengths.sum():
        return out
    features, sizes = np.concatenate([f for f, _ in found]), np.concatenate([s for _, s in found])
    good, _ = marginals(field.emissions(field.bins(features), *_ends(lengths)), lengths, field.steps)
    mean = _weighted(good, sizes, lengths)
    value = 1 / (1 + np.exp(-(field.scale * _logit(mean) + field.shift)))
    return np.where(lengths > 0, value, out)


def scorer(field: Field):
    """Column function: UTF-8 text to score."""

    @pandas_udf(DoubleType())
    def quality_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = texts.tolist()
            parts = [score_texts(field, values[i:i + BATCH]) for i in range(0, len(values), BATCH)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return lambda text: quality_score(text.cast("binary"))


def learn(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS,
) -> Field:
    """Fits the field on labelled documents whose crc32 remainder is not held out."""
    rows = labelled_sample(
        documents, labels, MODULUS, HELD_OUT, sample, sample_chars, id_col, text_col, label_col
    )
    return fit([t for _, t, _ in rows], [int(label > 0) for _, _, label in rows])


def assess(
    documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
    text_col: str = "text", **options,
) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    NULL, empty and blank texts get the learning documents' mean label as score;
    a NULL id counts as held out (nothing was learned from it). Repeated rows
    get equal scores; an empty table gives an empty table. Only id and text are
    read, whatever else the tables hold.
    """
    score = scorer(learn(documents, labels, id_col, text_col, **options))
    id_, text = documents[id_col], documents[text_col]
    scored = documents.select(
        id_.alias(id_col), F.coalesce(crc_mod(id_, MODULUS) == HELD_OUT, F.lit(True)).alias("held_out"),
        score(text).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accept(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", **options) -> DataFrame:
    """The documents whose score reaches the threshold, with all their columns."""
    score, name = scorer(learn(documents, labels, text_col=text_col, **options)), fresh("score")
    kept: Column = F.col(name) >= threshold
    return documents.withColumn(name, score(F.col(f"`{text_col}`"))).where(kept).drop(name)
