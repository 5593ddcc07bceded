"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text stands for each language. A text is parsed
into phrases, each the longest match that the automaton still knows; a text in
the automaton's language needs few, long phrases. The phrase count, times the
bits that point into the labelled text, per character, estimates the cross
entropy, and the language with the least wins. Where phrases begin inside words
much more often than in held-back learning text of that language, the text is in
none of the languages.

Automata are built on the driver from at most ``sample_docs`` labelled documents
and ``sample_chars`` characters per language, whatever the corpus size. Texts
are parsed whole: they are cut into segments that are parsed side by side with
numpy, one character of every segment and language per step.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from webstrata.llm.shared import crc_mod, fresh, pick, stretch

MODULUS, HELD_OUT = 4, 2
SAMPLE_DOCS, SAMPLE_CHARS, DOC_CHARS = 64, 16_000, (200, 2_000)
#: Languages that one model may tell apart.
MOST_LANGUAGES = 256
#: Symbol 0 and the most frequent characters of the labelled text, one symbol
#: each. All its other characters are written in digits, as in UTF-8: a leading
#: one and as many more as their number needs.
ALPHABET, DIGITS = 96, 32
#: Characters of the pieces that breaks inside words are fitted on, and the part of
#: the way from a language's usual rate of breaks to that of shuffled letters, and
#: standard deviations of a short text, up to which a text is in the language.
PIECE, WAY, DEVIATIONS = 256, 1 / 3, 2
SEGMENT, BATCH_CHARS = 1024, 4_000_000
UNKNOWN = "und"
RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
_LETTER = re.compile(r"[^\W\d_]")


def automaton(codes: list[int], alphabet: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``codes``: state x symbol, -1 where none."""
    next_: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(next_)
        next_.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in next_[p]:
            next_[p][c] = now
            p = link[p]
        if p >= 0:
            q = next_[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(next_)
                next_.append(dict(next_[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and next_[p].get(c) == q:
                    next_[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    table = np.full((len(next_), alphabet), -1, np.int32)
    for state, edges in enumerate(next_):
        table[state, list(edges)] = list(edges.values())
    return table


def _known(c: str) -> bool:
    """Characters that get a symbol: all up to U+FFFE, and letters beyond."""
    return ord(c) < 0xFFFF or c.isalpha()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Model:
    """``table``: all automata below each other, entries being the next row's
    start, negative (-1 - start) where a new phrase begins. ``rates``: breaks
    per pair of neighbouring letters, usual and by chance, of each language."""

    languages: list[str]
    symbols: str
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray
    rates: np.ndarray

    def codes(self, text: str) -> np.ndarray:
        return _codes(self.symbols, text)


_TABLES: dict[str, np.ndarray] = {}


def _lookup(symbols: str) -> np.ndarray:
    """Code point to the place of its character in ``symbols``, from 1; else 0."""
    key = f"{len(symbols)} {symbols}"
    if key not in _TABLES:
        table = np.zeros(0x110000, np.int32)
        table[[ord(c) for c in symbols]] = np.arange(1, len(symbols) + 1)
        _TABLES[key] = table
    return _TABLES[key]


def _digits(symbols: str) -> int:
    """Digits of each character that has no symbol of its own."""
    rest, digits = len(symbols) + 1 - ALPHABET, 2
    while DIGITS ** digits < rest:
        digits += 1
    return digits if rest > 0 else 0


def _width(symbols: str) -> int:
    return ALPHABET + 2 * DIGITS if _digits(symbols) else len(symbols) + 1


def _codes(symbols: str, text: str) -> np.ndarray:
    place = _lookup(symbols)[_points(text)]
    digits = _digits(symbols)
    if not digits or not (place >= ALPHABET).any():
        return place
    count = np.where(place >= ALPHABET, digits, 1)
    out = np.repeat(place, count)
    nth = np.arange(len(out)) - np.repeat(np.cumsum(count) - count, count)
    rare = out >= ALPHABET
    number, nth = out[rare] - ALPHABET, nth[rare]
    digit = number // DIGITS ** (digits - 1 - nth) % DIGITS
    out[rare] = ALPHABET + np.where(nth > 0, DIGITS, 0) + digit
    return out


def _letters() -> np.ndarray:
    """Code point to whether it is a letter."""
    if "" not in _TABLES:
        _TABLES[""] = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _TABLES[""]


def _inner(symbols: str, text: str) -> np.ndarray:
    """Whether each symbol of the coded text begins a letter that follows a letter."""
    points = _points(text)
    letter = _letters()[points]
    inner = np.r_[False, letter[1:] & letter[:-1]] if len(letter) else letter
    digits = _digits(symbols)
    if not digits:
        return inner
    count = np.where(_lookup(symbols)[points] >= ALPHABET, digits, 1)
    out = np.zeros(int(count.sum()), bool)
    out[np.cumsum(count) - count] = inner
    return out


def fit(samples: dict[str, list[str]]) -> Model:
    """The model of labelled texts by language."""
    counts: dict[str, int] = {}
    for parts in samples.values():
        for c in "\n".join(parts).lower():
            counts[c] = counts.get(c, 0) + 1
    symbols = "".join(sorted((c for c in counts if _known(c)), key=lambda c: (-counts[c], c)))
    ordered = dict(sorted(samples.items()))
    rates = [_rates(symbols, parts) for parts in ordered.values()]
    return _model(symbols, {lang: "\n".join(parts).lower() for lang, parts in ordered.items()}, np.array(rates))


def _model(symbols: str, texts: dict[str, str], rates: np.ndarray) -> Model:
    width, tables, roots, bits, base = _width(symbols), [], [], [], 0
    for text in texts.values():
        table = automaton(_codes(symbols, text).tolist(), width).astype(np.int64)
        # A symbol that does not go on begins a phrase: the step that it makes
        # from the start, or a phrase of its own where it is unknown. The last
        # row stands for that, and for the beginning: whatever follows is new.
        new = len(table)
        table = np.concatenate([table, np.full((1, width), -1)])
        start = np.where(table[0] >= 0, table[0], new)
        step = np.where(table >= 0, (table + base) * width, -1 - (start + base)[None, :] * width)
        tables.append(step.ravel())
        roots.append((base + new) * width)
        bits.append(math.log2(max(len(text), 2)))
        base += len(table)
    flat = np.concatenate(tables) if tables else np.zeros(0, np.int64)
    small = base * width < 2**31
    return Model(list(texts), symbols, flat.astype(np.int32 if small else np.int64), np.array(roots), np.array(bits), rates)


def _rates(symbols: str, parts: list[str]) -> tuple[float, float]:
    """Median rate of breaks in a language's learning text, and with its letters shuffled.

    Each half of the documents (of a single one, of its text) is parsed by the
    other half. Both are 1, which no text exceeds, where that tells nothing.
    """
    if len(parts) > 1:
        halves = ["\n".join(parts[k::2]).lower() for k in (0, 1)]
    else:
        whole = "\n".join(parts).lower()
        halves = [whole[:len(whole) // 2], whole[len(whole) // 2:]]
    models = [_model(symbols, {"": half}, np.ones((1, 2))) for half in halves]
    found: list[list[float]] = [[], []]
    for half, model in zip(halves, reversed(models), strict=True):
        letters = [c for c in half if c.isalpha()]
        random.Random(0).shuffle(letters)
        other = iter(letters)
        for rates, text in zip(found, (half, "".join(next(other) if c.isalpha() else c for c in half)), strict=True):
            _, breaks, pairs = _parse(model, [text[i:i + PIECE] for i in range(0, len(text), PIECE)])
            rates.extend(breaks[pairs > 0, 0] / pairs[pairs > 0])
    usual, chance = (float(np.median(rates)) if rates else 1.0 for rates in found)
    return (usual, chance) if usual < chance else (1.0, 1.0)


def phrases(model: Model, texts: list[str]) -> np.ndarray:
    """Phrases of each text (rows) under each language (columns)."""
    return _parse(model, texts)[0]


def _parse(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases, phrases that begin between two letters, and pairs of letters per text."""
    counts = np.zeros((len(texts), len(model.languages)), np.int64)
    breaks, pairs = np.zeros_like(counts), np.zeros(len(texts), np.int64)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def settle() -> None:
        owner = np.array([i for i, _, _ in held])
        length = np.array([len(s) for _, s, _ in held])
        order = np.argsort(-length, kind="stable")
        owner, length = owner[order], length[order]
        grid = np.zeros((int(length[0]), len(order)), np.int32)
        inner = np.zeros(grid.shape, bool)
        for column, at in enumerate(order):
            grid[:length[column], column] = held[at][1]
            inner[:length[column], column] = held[at][2]
        running = np.searchsorted(-length, -np.arange(len(grid)), "left")
        state = np.repeat(model.roots[:, None], len(order), axis=1).astype(model.table.dtype)
        found, broken = np.zeros(state.shape, np.int32), np.zeros(state.shape, np.int32)
        for t, n in enumerate(running):
            step = model.table[state[:, :n] + grid[t, :n]]
            new = step < 0
            found[:, :n] += new
            broken[:, :n] += new & inner[t, :n]
            state[:, :n] = np.where(new, -1 - step, step)
        for language in range(len(found)):
            counts[:, language] += np.bincount(owner, found[language], len(texts)).astype(np.int64)
            breaks[:, language] += np.bincount(owner, broken[language], len(texts)).astype(np.int64)
        held.clear()

    for i, text in enumerate(texts):
        codes, inner = model.codes(text), _inner(model.symbols, text)
        inner[::SEGMENT] = False
        pairs[i] = inner.sum()
        for start in range(0, len(codes), SEGMENT):
            held.append((i, codes[start:start + SEGMENT], inner[start:start + SEGMENT]))
            size += SEGMENT
            if size >= BATCH_CHARS:
                settle()
                size = 0
    if held:
        settle()
    return counts, breaks, pairs


def identify_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, score) per text.

    The score compares the two best languages: 0.5 where they need equally many
    bits, near 1 where the best needs far fewer; 0 for ``und``. With a single
    language it is 1. It is below 0.5 where the words are broken more often than
    the best language allows: such a text is in none of the languages.
    """
    letters = np.array([bool(t and _LETTER.search(t)) for t in texts], bool)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    kept = [t if ok else "" for t, ok in zip(texts, letters, strict=True)]
    length = np.array([max(len(t or ""), 1) for t in kept])
    found, breaks, pairs = _parse(model, kept)
    bits = found * model.bits / length[:, None]
    best = bits.argmin(axis=1)
    usual, chance = model.rates[best].T
    most = usual + WAY * (chance - usual) + DEVIATIONS * np.sqrt(usual * (1 - usual) / np.maximum(pairs, 1))
    if len(model.languages) > 1:
        two = np.partition(bits, 1, axis=1)[:, :2]
        # Certainty grows with the relative gap and with the text.
        gap = (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1e-9)
        score = 1 / (1 + np.exp(-gap * np.sqrt(length)))
    else:
        score = np.ones(len(texts))
    # Of none of the languages: below 0.5, and the lower the more breaks.
    own = breaks[np.arange(len(texts)), best]
    score = np.where(own > most * pairs, score * 0.5 * most * pairs / np.maximum(own, 1), score)
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
    return names, np.where(letters, score, 0.0)


def identifier(spark, model: Model):
    """Column function: text to struct (lang_pred, score).

    The automata, of a size bounded by the sample, go out as one broadcast.
    """
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf(RESULT)
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = identify_texts(shared.value, texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return lambda text: language(text)


#: A long document gives one part in so many of a language's learning text.
STRETCHES = 8


def learn(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS,
) -> Model:
    """Automata from documents whose crc32 remainder is not held out.

    Per language the first documents by md5 of the id are taken, whole, first
    those of ordinary length (``DOC_CHARS``), until ``sample_chars`` is reached. Of
    documents longer than that, which come last, a stretch is taken.
    """
    narrow = documents.select(
        documents[id_col].alias("id"), documents[lang_col].alias("lang"), F.length(documents[text_col]).alias("size")
    ).where(
        F.col("lang").isNotNull() & (crc_mod(F.col("id"), MODULUS) != HELD_OUT)
        & (F.col("size") > 0)
    )
    order = [F.col("size") > sample_chars, (~F.col("size").between(*DOC_CHARS)).cast("int"), F.md5(F.col("id").cast("string")), "size"]
    first = narrow.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    chosen = first.where(F.col("nth") <= sample_docs).select("lang", "nth", "id")
    chosen = chosen.limit(MOST_LANGUAGES * sample_docs + 1).collect()
    ids = documents.sparkSession.createDataFrame([(i,) for i in {r["id"] for r in chosen}], narrow.select("id").schema)
    part = F.when(F.length("text") > sample_chars, stretch(F.col("text"), F.col("id"), sample_chars // STRETCHES))
    whole = pick(documents, id=id_col, text=text_col).where(F.length("text") > 0).withColumn("text", part.otherwise(F.col("text")))
    texts = {
        r["id"]: r["text"]
        for r in whole.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text")).collect()
    }
    rows = [{"lang": r["lang"], "nth": r["nth"], "text": texts[r["id"]]} for r in chosen]
    samples: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["nth"])):
        own = samples.setdefault(row["lang"], [])
        if sum(map(len, own)) + len(row["text"]) <= sample_chars:
            own.append(row["text"])
    if len(samples) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return fit(samples)


def identify(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options
) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score.

    ``und`` with score 0 where the text is NULL or has no letter, and where no
    language could be learned. A score below 0.5 means none of the languages. A NULL id counts as held out. Ties go to the
    language first by name. Only id, text and the learning rows' lang are read.
    """
    model = learn(documents, id_col, text_col, lang_col, **options)
    language = identifier(documents.sparkSession, model)
    id_, found = documents[id_col], fresh("found")
    return documents.select(
        id_.alias(id_col), F.coalesce(crc_mod(id_, MODULUS) == HELD_OUT, F.lit(True)).alias("held_out"),
        language(documents[text_col]).alias(found),
    ).select(id_col, "held_out", f"{found}.lang_pred", f"{found}.score")


def accept(
    documents: DataFrame, least_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
    lang_col: str = "lang", **options,
) -> DataFrame:
    """The documents whose language is known with ``least_score``; all columns stay."""
    model = learn(documents, id_col, text_col, lang_col, **options)
    language, found = identifier(documents.sparkSession, model), fresh("found")
    marked = documents.withColumn(found, language(F.col(f"`{text_col}`")))
    return marked.where((F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.score") >= least_score)).drop(found)
