"""Packing documents into fixed-length token sequences by minimum bin slack.

A bin is filled by a subset-sum search over the lengths that are still there:
with the longest one fixed, a bitset of reachable fill levels is grown length by
length, and the combination behind the highest level is taken. A combination is
repeated while its lengths last, so each one uses up at least one length and the
plan has at most ``capacity`` of them, whatever the number of documents. Only
that histogram of at most ``capacity`` lengths reaches the driver; documents
find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm.shared import pick
from webstrata.llm.tokens import shared_encoder
from webstrata.session import cut_lineage

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END_OF_TEXT = 0

_PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
)


def cut(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole bins, a shorter one first."""
    first = tokens % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, tokens, capacity))]


def _tokenize(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = shared_encoder(tokenizer), np.uint32(end_id).tobytes()
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, pieces, starts, lengths, crcs, nth = [], [], [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stream = encoder.encode(text.as_py() or "") + end
                for piece, (start, length) in enumerate(cut(len(stream) // 4, capacity)):
                    ids.append(doc_id)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(length)
                    crcs.append(zlib.crc32(stream[4 * start:4 * (start + length)]))
                    nth.append(int(seen[length]))
                    seen[length] += 1
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()),
                    pa.array(repeat(part, len(ids)), pa.int64(), size=len(ids)), pa.array(nth, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return run


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, copies) with the largest sum within ``room`` from ``counts``.

    Bit ``x`` of a level says that ``x`` is reachable; longer lengths come
    first, and on the way back fewer and longer pieces are preferred.
    """
    full, levels, reach = 1 << room, [], 1
    mask = (full << 1) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        steps = min(counts[length], room // length)
        before, grown, spread = reach, reach, 1
        while steps:  # doubling: 1, 2, 4, ... copies at a time
            take = min(spread, steps)
            grown |= (grown << (length * take)) & mask
            steps -= take
            spread *= 2
        levels.append((length, before))
        reach = grown
        if reach & full:
            break
    level, chosen = reach.bit_length() - 1, []
    for length, before in reversed(levels):
        copies = 0
        while not before >> level & 1:
            level -= length
            copies += 1
        if copies:
            chosen.append((length, copies))
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go.

    Rows (length, first rank, end rank, first sequence, copies in a sequence,
    offset of the first copy): rank r of a run lies in sequence
    ``first + (r - first rank) // copies``.
    """
    left = {k: v for k, v in histogram.items() if v}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        others = {k: v - (k == longest) for k, v in left.items() if v > (k == longest)}
        bin_ = {longest: 1}
        for length, copies in fullest(others, capacity - longest):
            bin_[length] = bin_.get(length, 0) + copies
        times = min(left[k] // c for k, c in bin_.items())
        offset = 0
        for length, copies in sorted(bin_.items(), reverse=True):
            rows.append((length, used[length], used[length] + times * copies, sequence, copies, offset))
            used[length] += times * copies
            left[length] -= times * copies
            if not left[length]:
                del left[length]
            offset += length * copies
        sequence += times
    return rows


def _place(rows: list[tuple[int, int, int, int, int, int]]):
    """Task: appends sequence_id and offset to rows that end in (length, rank)."""
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    # Runs of a length are sorted by rank; rank by length in one number.
    starts: dict[int, np.ndarray] = {n: table[table[:, 0] == n] for n in np.unique(table[:, 0]).tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                own, runs = np.flatnonzero(length == n), starts[n]
                run_ = runs[np.searchsorted(runs[:, 1], rank[own], "right") - 1]
                ahead, place = np.divmod(rank[own] - run_[:, 1], run_[:, 4])
                sequence[own], offset[own] = run_[:, 3] + ahead, run_[:, 5] + place * n
            columns = [batch.column(batch.schema.get_field_index(c)) for c in _OUT[:5]]
            yield pa.record_batch([*columns, pa.array(sequence), pa.array(offset)], list(_OUT))

    return run


_OUT = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pieces(
    documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_OF_TEXT,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Token pieces of every document, with their running number per task and length."""
    narrow = pick(documents, doc_id=id_col, text=text_col)
    path = public_tokenizers.path(tokenizer)
    return narrow.mapInArrow(_tokenize(path, capacity, end_id), _PIECES)


def pack(
    documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, end_id: int = END_OF_TEXT,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every document ends with ``end_id``. One longer than ``capacity`` is cut
    into whole sequences, the first piece being the shorter one. NULL and empty
    texts are a piece of one token; repeated rows and NULL ids are packed like
    any other row; an empty table gives an empty table. Further columns of the
    input play no part.

    The pieces are written once; the running number within a task, plus the
    counts of earlier tasks, ranks a piece among those of its length without
    bringing a length together.
    """
    written = cut_lineage(pieces(documents, capacity, tokenizer, end_id, id_col, text_col))
    counts = cut_lineage(written.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = written.join(base, ["part", "length"]).select(
        *_OUT[:5], (F.col("base") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(
        _place(plan(histogram, capacity)),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
