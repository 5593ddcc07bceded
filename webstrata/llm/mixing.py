"""Mixing sources to target weights with a low-discrepancy slot schedule.

The mix is a row of slots of equally many words. Slot ``i`` stands at the point
``frac(i * golden ratio)`` (kept as a 32-bit integer), and the source whose
interval of cumulative targets holds that point fills it. The slots of a source
are ranked; its documents are shuffled, laid end to end as one stream of words,
repeated as often as needed and cut into blocks of a slot's size; the slot of
rank ``r`` takes block ``r``. Golden-ratio points keep every run of slots, and
so every stretch of the mix, close to the targets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webstrata.llm.shared import LOCATION, fresh, join_lines, line_maps, located, pick
from webstrata.session import cut_lineage, scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: A source is taken at most so many times over.
MOST_REPEATS = 3
#: Least number of slots, and least per source; more sources get more slots.
SLOTS, SLOTS_PER_SOURCE = 1 << 17, 1024
#: Sources are categories; a column with more values than this is refused.
MOST_SOURCES = 1_000_000
#: 2**32 divided by the golden ratio: multiples of it modulo 2**32 are the points.
GOLDEN = 2654435769


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Share:
    source: str | None
    size: int
    numerator: int  # of the target, over a denominator that all share
    denominator: int
    low: int  # interval of points, out of 2**32
    high: int

    @property
    def target(self) -> float:
        return self.numerator / self.denominator


def shares(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> list[Share]:
    """Targets in whole-number arithmetic.

    Sources in code point order, NULL last, take the weights in turn and share
    the total size; a target stops at ``most`` times its source's size and the
    excess is shared again by weight until no target is above.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest, parts = total - sum(most * sizes[s] for s in capped), sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * rest > most * sizes[s] * parts}
        if not over:
            break
        capped |= over
    parts, out, seen = max(parts, 1), [], 0
    for s in names:
        numerator = most * sizes[s] * parts if s in capped else weight[s] * rest
        whole = max(total * parts, 1)
        low, high = ((x << 32) // whole for x in (seen, seen + numerator))
        out.append(Share(s, sizes[s], numerator, parts, low, high))
        seen += numerator
    return out


def _owners(slot: np.ndarray, highs: np.ndarray) -> np.ndarray:
    point = (slot.astype(np.uint64) * np.uint64(GOLDEN)) & np.uint64(0xFFFFFFFF)
    return np.searchsorted(highs, point.astype(np.int64), "right")


def slots_of(slots: int, parts: list[Share]) -> list[int]:
    """Number of slots of each source, counted a million slots at a time."""
    highs, out = np.array([p.high for p in parts], np.int64), np.zeros(len(parts), np.int64)
    for low in range(0, slots, 1 << 20):
        out += np.bincount(_owners(np.arange(low, min(slots, low + (1 << 20))), highs), minlength=len(parts))
    return out.tolist()


def _owner(highs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(0).to_numpy()
            owner = _owners(slot, highs)
            yield pa.record_batch([pa.array(slot), pa.array(owner)], ["slot", "owner"])

    return run


def schedule(spark: SparkSession, slots: int, parts: list[Share]) -> DataFrame:
    """(slot, owner, rank): the source of each slot and its place among that source's slots."""
    owners = spark.range(slots).mapInArrow(_owner(np.array([p.high for p in parts], np.int64)), "slot long, owner long")
    rank = F.row_number().over(Window.partitionBy("owner").orderBy("slot")).cast("long") - 1
    return owners.select("slot", "owner", rank.alias("rank"))


def stream_positions(rows: DataFrame, seed: int, digits: int) -> DataFrame:
    """Adds ``at``: words before a document in its source's shuffled stream.

    The shuffle orders by md5 of seed and id. A source is cut by the leading
    digits of that key, so one with most rows is summed by many tasks.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    keyed = rows.withColumn("key", key).withColumn("cut", F.substring("key", 1, digits))
    sums = keyed.groupBy("owner", "cut").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("owner").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("owner", "cut", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = (
        Window.partitionBy("owner", "cut").orderBy("key", "id", "size", "row")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = keyed.withColumn("local", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return local.join(base, ["owner", "cut"]).select(*rows.columns, (F.col("local") + F.col("base")).alias("at"))


@dataclass(frozen=True)
class Mix:
    """``documents``: row, id, owner, size, source_size, target, slots; ``pieces``: slot,
    owner, rank, row, turn (repetition of the source), start (word in the
    document), words. The pieces in slot order are the mix."""

    documents: DataFrame
    pieces: DataFrame
    block: int


def mix(
    rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = 0,
    slots: int = SLOTS, exact: bool = False,
) -> Mix:
    """Schedule of the mix over a written table (row, id, source, size).

    ``row`` tells rows apart. NULL sources are a source of their own, the last;
    rows of size 0 are never taken; repeated rows are mixed like any other; an
    empty table gives empty tables. A source whose slots would exceed ``most``
    times its size stops exactly there.

    With ``exact`` every source ends at its own target, rounded to a word: its
    last slot is partial, slots beyond stay empty, and blocks for which the points
    gave it no slot are spread evenly over the mix, beside the slots' own owners.
    """
    spark = rows.sparkSession
    by_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    found = by_source.limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    parts = shares({r["source"]: r["size"] for r in found}, weights, most)
    total, count = sum(p.size for p in parts), sum(r["n"] for r in found)
    block = max(1, math.ceil(total / max(slots, SLOTS_PER_SOURCE * len(parts))))
    number = math.ceil(total / block)
    filled = slots_of(number, parts)
    words = [
        (2 * p.numerator + p.denominator) // (2 * p.denominator) if exact else min(n * block, p.size * most)
        for p, n in zip(parts, filled, strict=True)
    ]
    table = spark.createDataFrame(
        [(p.source, i, p.size, p.target, words[i], filled[i]) for i, p in enumerate(parts)],
        "name string, owner long, source_size long, target double, words long, slots long",
    )
    owned = rows.join(table, rows["source"].eqNullSafe(table["name"])).drop("name")
    plan = schedule(spark, number, parts)
    digits = max(1, min(6, math.ceil(math.log(max(count, 1) / 1024 + 1, 16))))
    laid = stream_positions(owned.where("size > 0 AND words > 0"), seed, digits)
    turns = laid.withColumn("turn", F.explode(F.expr("sequence(0L, (words - 1) div source_size)")))
    begin = F.col("turn") * F.col("source_size") + F.col("at")
    end = F.least(begin + F.col("size"), F.col("words"))
    cut = (
        turns.select("row", "owner", "words", "turn", begin.alias("begin"), end.alias("end")).where("end > begin")
        .select("*", F.explode(F.expr(f"sequence(begin div {block}, (end - 1) div {block})")).alias("rank"))
    )
    low = F.greatest("begin", F.col("rank") * block)
    high = F.least("end", (F.col("rank") + 1) * block)
    # Only an exact mix has blocks without a slot: those go evenly over all slots.
    blocks = F.ceil(F.col("words") / block).cast("long")
    spread = F.floor((F.col("rank") + 0.5) * number / blocks).cast("long")
    pieces = cut.join(plan, ["owner", "rank"], "left").select(
        F.coalesce("slot", spread).alias("slot"), "owner", "rank", "row", "turn", (low - F.col("begin")).alias("start"), (high - low).alias("words")
    )
    return Mix(owned, pieces, block)


def taken(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: id, size, source_size, target, words taken and the source's golden-ratio slots.

    NULL texts have size 0. Further columns of the input play no part.
    """
    narrow = pick(documents, id=id_col, source=source_col, text=text_col)
    rows = cut_lineage(
        narrow.select(F.monotonically_increasing_id().alias("row"), "id", "source", size_of(F.col("text")).alias("size"))
    )
    made = mix(rows, **options)
    per_row = made.pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    return made.documents.join(per_row, "row", "left").select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "slots"
    )


def mixed(documents: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", chars_col: str = "n_chars", **options) -> DataFrame:
    """The documents as the mix takes them, one row per repetition.

    All columns stay. The last document of a source's last repetition may be
    cut where its target ends (its first words stay, and ``chars_col`` is
    counted anew); documents that the mix does not take, go.
    """
    names = documents.columns
    table, place_of = located(documents)
    turn, kept = fresh("turn"), fresh("words")
    with scratch(documents.sparkSession) as keep:
        placed = cut_lineage(table.select(
            *place_of, F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"),
            F.col(f"`{source_col}`").alias("source"), size_of(F.col(f"`{text_col}`")).alias("size"),
        ))
        made = mix(placed.select("row", "id", "source", "size"), **options)
        turns = made.pieces.groupBy("row", "turn").agg(F.sum("words").alias("words"))
        copies = cut_lineage(turns.join(placed, "row").select(
            *LOCATION, F.col("turn").alias(turn), F.col("words").alias(kept), "size"
        ))
        maps = keep(line_maps(copies, turn))
        ends = keep(copies.where(F.col(kept) != F.col("size")).drop("size"))
    # The text up to its n-th word: words with the white space before them.
    steps = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    first = F.array_join(F.slice(steps, F.lit(1), F.col(kept).cast("int")), "")
    # Texts stay in their table: only places and word counts were shuffled. A source
    # ends once, so there is at most one cut document for each.
    joined = join_lines(table, place_of, maps, "inner").join(F.broadcast(ends), [*LOCATION, turn], "left")
    whole, out = F.col(kept).isNull(), []
    for c in names:
        value = F.col(f"`{c}`")
        if c == text_col:
            value = F.when(whole, value).otherwise(first)
        elif c == chars_col:
            value = F.when(whole, value).otherwise(F.length(first)).cast(documents.schema[c].dataType)
        out.append(value.alias(c))
    return joined.select(*out)
