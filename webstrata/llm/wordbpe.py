"""Byte-level BPE by a global shuffle of distinct words.

Texts are exploded into pre-tokens with their positions, block by block: a block
is a bounded run of documents of one task, and holds its distinct pre-tokens plus
the position of every pre-token, as one compressed sequence of word numbers.
Blocks are written once, in rows of bounded size bucketed by block, and stay where they are. The distinct
words of all blocks are shuffled by word; where equal words meet, the word is
merged once and its ids go back to every block that holds it, which puts its
documents together again by position. Decoding looks every id up in the table of
token bytes, whose size is that of the vocabulary file.

A word that stands everywhere is one small row per block, so no task grows with
the number of its occurrences, and a block (or one document, where that is
larger) is the most that a task holds.
"""

from __future__ import annotations

import base64
import contextlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.shared import pick
from webstrata.session import bucketed

RANKS = "byte_bpe_multi_50k.tiktoken"
#: A block is closed at the end of the row with which it reaches this many pre-tokens.
BLOCK_WORDS = 6_000_000
#: Blocks that one task may make.
TASK_BLOCKS = 1 << 11
#: Merged rows that a task gathers before it sends them back, one packed row per block.
RETURN_ROWS = 400_000
#: Numbers of a block that are packed, unpacked or looked up at once, so that the
#: work arrays of a task do not grow with its block.
STEP = 1 << 18
#: A block's documents go back in batches that are closed with the one that reaches this many ids.
BATCH_IDS = 1 << 21
#: A block is written in rows of about this size, so that no buffer of the JVM holds it in one value.
PIECE_BYTES = 1 << 20
#: Bytes of texts that Spark sends to a task at once, whose number of rows alone would not bound them.
BATCH_BYTES = 1 << 22
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Longer texts are split piece by piece instead of into one list.
LONG_TEXT = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from a file of base64 tokens and ids."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


def _splitter(pattern: str) -> Callable[[str | None], Iterable[str]]:
    split = regex.compile(pattern)

    def words(text: str | None) -> Iterable[str]:
        if not text:
            return ()
        if len(text) > LONG_TEXT:
            return (m.group() for m in split.finditer(text))
        return split.findall(text)

    return words


def _seven_bits(left: np.ndarray) -> bytes:
    left = left.astype(np.uint32)
    size = np.maximum(1, (np.frexp(left.astype(np.float64))[1] + 6) // 7)
    coded = np.empty((len(left), 5), np.uint8)
    for k in range(5):
        coded[:, k] = (left & 127) | np.where(size > k + 1, 128, 0)
        left >>= 7
    return coded[np.arange(5) < size[:, None]].tobytes()


def pack_numbers(numbers: np.ndarray, rank: np.ndarray | None = None) -> bytes:
    """Unsigned 32-bit numbers (their ranks, if given) at 7 bits a byte, the lowest first, compressed over the whole block."""

    def steps() -> Iterator[np.ndarray]:
        for low in range(0, len(numbers), STEP):
            yield numbers[low:low + STEP] if rank is None else rank[numbers[low:low + STEP]]

    # Told its size, the compressor takes no larger window than it needs.
    size = len(numbers) + sum(np.count_nonzero(left >= 1 << 7 * k) for left in steps() for k in range(1, 5))
    options = zstandard.ZstdCompressionParameters.from_level(3, window_log=24, enable_ldm=True)
    packer = zstandard.ZstdCompressor(compression_params=options).compressobj(size=int(size))
    return b"".join([*(packer.compress(_seven_bits(left)) for left in steps()), packer.flush()])


def _unpacked(packed: bytes) -> Iterator[np.ndarray]:
    """The numbers of ``pack_numbers``, a step at a time."""
    reader, rest = zstandard.ZstdDecompressor().stream_reader(packed), b""
    while plain := reader.read(STEP):
        coded = np.frombuffer(rest + plain, np.uint8)
        ends = np.flatnonzero(coded < 128)
        if not len(ends):  # a number ends in the slice after
            rest += plain
            continue
        part, rest = coded[:ends[-1] + 1], coded[ends[-1] + 1:].tobytes()
        starts = np.r_[0, ends[:-1] + 1]
        place = (np.arange(len(part)) - np.repeat(starts, ends + 1 - starts)).astype(np.uint32)
        yield np.add.reduceat((part & 127).astype(np.uint32) << (7 * place), starts, dtype=np.uint32)


def unpack_numbers(packed: bytes) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint32), *_unpacked(packed)])


class _Numbers(dict):
    """Numbers words in the order of their first appearance."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class _Block:
    """Documents of one block: keys, word numbers, ends of the documents."""

    def __init__(self):
        self.numbers, self.sequence, self.ends, self.keys = _Numbers(), array("I"), [], []

    def hold(self, keys: pa.Array, first: int, end: int) -> None:
        # Copied: a slice would keep its whole batch, texts included, in memory.
        self.keys.append(keys.take(pa.array(np.arange(first, end))))

    def pieces(self, block: int) -> Iterator[pa.RecordBatch]:
        """The block, written once, in rows of about ``PIECE_BYTES``; the block is empty afterwards."""
        # Frequent words get the small numbers, so that most high bytes are zero.
        sequence, n = np.frombuffer(self.sequence, np.uint32), len(self.numbers)
        often = np.zeros(n, np.int64)
        for low in range(0, len(sequence), STEP):
            often += np.bincount(sequence[low:low + STEP], minlength=n)
        order = np.argsort(-often, kind="stable")
        rank = np.empty(n, np.uint32)
        rank[order] = np.arange(n, dtype=np.uint32)
        words = pa.array(list(self.numbers), pa.string()).take(pa.array(order))
        self.numbers = None  # the largest part of a block
        columns = [pa.concat_arrays(self.keys), pa.array(self.ends, pa.int64()), words, pack_numbers(sequence, rank)]
        self.keys = self.ends = self.sequence = None
        rows = 1 + (sum(c.nbytes for c in columns[:3]) + len(columns[3])) // PIECE_BYTES
        for row in range(rows):
            cuts = [slice(len(c) * row // rows, len(c) * (row + 1) // rows) for c in columns]
            keys, ends, words, positions = (c[cut] for c, cut in zip(columns, cuts, strict=True))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (keys, ends, words)]
            yield pa.record_batch(
                [
                    pa.array([block], pa.int32()), pa.array([row], pa.int32()), *lists[:2],
                    pa.array([cuts[2].start], pa.int32()), lists[2], pa.array([positions], pa.binary()),
                ],
                ["block", "piece", "keys", "ends", "first_word", "words", "positions"],
            )


def _explode(pattern: str, block_words: int):
    """Task: rows (key, text) to blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, made, block = _splitter(pattern), TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            first = 0
            for row, text in enumerate(batch.column(1)):
                block.sequence.extend(map(block.numbers.__getitem__, words(text.as_py())))
                block.ends.append(len(block.sequence))
                if len(block.sequence) >= block_words:
                    block.hold(batch.column(0), first, row + 1)
                    yield from block.pieces(part * TASK_BLOCKS + made)
                    made, first, block = made + 1, row + 1, _Block()
                    if made == TASK_BLOCKS:
                        raise ValueError(f"a task holds more than {TASK_BLOCKS} blocks: read the table in more partitions")
            if first < batch.num_rows:
                block.hold(batch.column(0), first, batch.num_rows)
        if block.ends:
            yield from block.pieces(part * TASK_BLOCKS + made)

    return run


def _merge(path: str, pattern: str):
    """Task: rows (word, place) sorted by word to packed ids; a word is merged once.

    An output row holds some words of one block: the gaps between their numbers,
    how many ids each has, and the ids, one after the other.
    """

    def packed(places: list[np.ndarray], counts: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        place, count, flat = map(np.concatenate, (places, counts, ids))
        order = np.argsort(place)
        first = (np.cumsum(count) - count)[order]
        place, count = place[order], count[order]
        ends = np.cumsum(count)
        # Ids in the order of the places: the start of each run, counted on.
        flat = flat[np.repeat(first - (ends - count), count) + np.arange(len(flat))]
        block, slot = place >> 32, place & 0xFFFFFFFF
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist()
        id_at = np.r_[0, ends].tolist()
        columns = [[], [], [], []]
        for a, b in zip(starts, [*starts[1:], len(block)], strict=True):
            values = block[a], np.diff(slot[a:b], prepend=0), count[a:b], flat[id_at[a]:id_at[b]]
            for column, value in zip(columns, (int(values[0]), *map(pack_numbers, values[1:])), strict=True):
                column.append(value)
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.record_batch(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["of_block", "gaps", "counts", "ids"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        last, ids, held, size = None, [], ([], [], []), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs = batch.column(0).dictionary_encode()
            of_run = []
            for word in runs.dictionary.to_pylist():
                if word != last:
                    # A word is one match already; it is merged without being split again.
                    last, ids = word, engine._encode_single_piece(word.encode())
                of_run.append(ids)
            values = pa.array(of_run, pa.list_(pa.uint32())).take(runs.indices)
            rows = batch.column(1).to_numpy(), np.diff(values.offsets.to_numpy()), values.flatten().to_numpy()
            for part, own in zip(held, rows, strict=True):
                part.append(own)
            size += len(rows[0]) + len(rows[2])
            if size >= RETURN_ROWS:
                yield packed(*held)
                held, size = ([], [], []), 0
        if size:
            yield packed(*held)

    return run


def _ids_of(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word of a block: its first id's place, its number of ids; and the ids."""
    rows = ([unpack_numbers(v.as_py()) for v in found.column(c)] for c in ("gaps", "counts", "ids"))
    gaps, counts, ids = ([*r, np.zeros(0, np.uint32)] for r in rows)
    slot = np.concatenate([np.cumsum(g, dtype=np.int64) for g in gaps])
    count = np.concatenate(counts).astype(np.int64)
    first, size = np.empty(len(slot), np.int64), np.empty(len(slot), np.int64)
    first[slot], size[slot] = np.cumsum(count) - count, count
    return first, size, np.concatenate(ids)


def _rebuild(blocks: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of one block, its pieces in order: ids of their words, in order of position."""
    first, size, ids = _ids_of(found)
    keys, ends = (pa.concat_arrays([c.flatten() for c in blocks.column(n).chunks]) for n in ("keys", "ends"))
    ends = ends.to_numpy()
    # Ids up to the end of each document; ids that are not in a batch yet.
    id_ends, held = np.zeros(len(ends), np.int64), [np.zeros(0, np.uint32)]
    batches, done, start, low, before = [], 0, 0, 0, 0

    def close(stop: int) -> None:
        nonlocal done, start
        flat, end = np.concatenate(held), int(id_ends[stop - 1])
        bounds = 4 * (np.r_[start, id_ends[done:stop]] - start)
        buffers = [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(flat[:end - start])]
        coded = pa.Array.from_buffers(pa.binary(), stop - done, buffers)
        batches.append(pa.record_batch([keys.slice(done, stop - done), coded], ["key", "ids"]))
        held[:] = [flat[end - start:].copy()]
        done, start = stop, end

    for words in _unpacked(b"".join(blocks.column("positions").to_pylist())):
        count = size[words]
        total = np.cumsum(count)
        # The first id of each word, counted on.
        held.append(ids[np.repeat(first[words] - (total - count), count) + np.arange(total[-1])])
        here = slice(*np.searchsorted(ends, [low, low + len(words)], "right").tolist())
        id_ends[here] = before + total[ends[here] - low - 1]
        low, before = low + len(words), before + int(total[-1])
        if here.stop > done and id_ends[here.stop - 1] - start >= BATCH_IDS:
            close(here.stop)
    if done < len(ends):
        close(len(ends))
    return pa.Table.from_batches(batches)


@contextlib.contextmanager
def _short_batches(spark: SparkSession) -> Iterator[None]:
    """Tasks that run inside the block get batches of about ``BATCH_BYTES``."""
    before = spark.conf.get(BATCH_CONF, None)
    spark.conf.set(BATCH_CONF, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_CONF) if before is None else spark.conf.set(BATCH_CONF, before)


def _rebuild_pieces(blocks: pa.Table, found: pa.Table) -> pa.Table:
    return _rebuild(blocks.take(np.argsort(blocks.column("piece").to_numpy())), found)


def encode(
    documents: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN,
    id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: id and ``ids`` (binary, little-endian unsigned 32-bit).

    Each match of ``pattern`` is merged by the ranks of the file. NULL and empty
    texts have no ids; repeated rows and NULL ids are encoded like any other
    row; texts and words may be of any length; an empty table gives an empty
    table. Further columns of the input play no part.
    """
    rows = pick(documents, key=id_col, text=text_col)
    path = public_tokenizers.path(ranks)
    key = rows.schema["key"].dataType.simpleString()
    with _short_batches(rows.sparkSession):
        blocks = bucketed(
            rows.mapInArrow(
                _explode(pattern, block_words),
                f"block int, piece int, keys array<{key}>, ends array<long>, first_word int, words array<string>, positions binary",
            ),
            "block",
        )
    # Block and number of a word in one value, since one row per distinct word and block is shuffled.
    place = F.shiftleft(F.col("block").cast("long"), 32) + F.col("first_word") + F.col("slot")
    placed = blocks.select(F.posexplode("words").alias("slot", "word"), "block", "first_word").select("word", place.alias("place"))
    found = placed.repartition("word").sortWithinPartitions("word").mapInArrow(
        _merge(path, pattern), "of_block int, gaps binary, counts binary, ids binary"
    )
    built = (
        blocks.select("block", "piece", "keys", "ends", "positions").groupBy("block").cogroup(found.groupBy("of_block"))
        .applyInArrow(_rebuild_pieces, f"key {key}, ids binary")
    )
    return built.select(F.col("key").alias(id_col), "ids")


def _look_up(path: str):
    """Task: appends the bytes of the ids in the second column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_of = {rank: token for token, rank in read_ranks(path).items()}
        for batch in batches:
            out, first, size = [], 0, 0
            for row, value in enumerate(batch.column(1)):
                ids = np.frombuffer(value.as_py() or b"", "<u4").tolist()
                out.append(b"".join(map(token_of.__getitem__, ids)))
                size += len(ids)
                if size >= STEP or row + 1 == batch.num_rows:
                    keys = batch.column(0).slice(first, len(out))
                    yield pa.record_batch([keys, pa.array(out, pa.binary())], ["key", "decoded"])
                    out, first, size = [], row + 1, 0

    return run


def decode(encoded: DataFrame, ranks: str = RANKS, key_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: its key and ``decoded``, the bytes of its ids.

    Ids are joined to the table of token bytes inside the scan: every task holds
    that table, which has as many rows as the vocabulary file, so nothing is
    shuffled. NULL and empty ids decode to nothing; an id that the file does not
    have is an error.
    """
    rows = pick(encoded, key=key_col, ids=ids_col)
    key = rows.schema["key"].dataType.simpleString()
    found = rows.mapInArrow(_look_up(public_tokenizers.path(ranks)), f"key {key}, decoded binary")
    return found.select(F.col("key").alias(key_col), "decoded")


def round_trip(documents: DataFrame, ranks: str = RANKS, **options) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded and decoded again."""
    coded = encode(pick(documents, doc_id=options.pop("id_col", "doc_id"), text=options.pop("text_col", "text")), ranks, **options)
    digests = F.struct(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256")
    )
    decoded = decode(coded.select(digests.alias("doc"), "ids"), ranks, key_col="doc")
    return decoded.select("doc.*", F.sha2("decoded", 256).alias("decoded_sha256"))
