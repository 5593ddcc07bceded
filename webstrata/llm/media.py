"""Media columns: lossless images in archive folders behind a Spark data source.

A text's bytes, filled up with spaces to rows of 192, are the 8-bit samples of an
RGB image 64 pixels wide, stored as PNG. Images are members of tar archives that
roll over at a size; beside each archive stands the list of member offsets. The
reader plans (archive, byte range) partitions from the manifest alone, streams
members as bounded Arrow batches, and reads every member on its own by offset:
a failed one is read again from a newly opened file without touching the others.

Folders are opened through ``pyarrow.fs`` (local, HDFS, S3, GCS addresses).
"""

from __future__ import annotations

import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
)
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from webstrata.llm import files
from webstrata.llm.shared import pick

FORMAT = "image_archive"
PIXELS = 64
ROW_BYTES, FILL = 3 * PIXELS, b" "
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, BATCH_ROWS = 128 << 20, 16 << 20, 8 << 20, 1024
TRIES, LEVEL, BLOCK = 3, 4, 512
INDEX = ".idx"
SCHEMA = "doc_id long, n_bytes long, media binary, payload binary"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    return data + FILL * (-len(data) % ROW_BYTES or (0 if data else ROW_BYTES))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(data: bytes) -> bytes:
    """PNG of the padded bytes; the length without padding is a text chunk."""
    samples = np.frombuffer(padded(data), np.uint8).reshape(-1, ROW_BYTES)
    rows = np.zeros((len(samples), ROW_BYTES + 1), np.uint8)  # filter 0 before each row
    rows[:, 1:] = samples
    head = struct.pack(">IIBBBBB", PIXELS, len(samples), 8, 2, 0, 0, 0)
    return _SIGNATURE + b"".join((
        _chunk(b"IHDR", head), _chunk(b"tEXt", b"Length\0%d" % len(data)),
        _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)), _chunk(b"IEND", b""),
    ))


def decode(media: bytes) -> tuple[int, bytes]:
    """(length without padding, samples) of an image that ``encode`` wrote."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, length, size, packed = 8, None, None, b""
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8:at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", data)
        elif kind == b"tEXt":
            length = int(data.partition(b"\0")[2])
        elif kind == b"IDAT":
            packed += data
        at += 12 + n
    if size is None or length is None or size[2:] != (8, 2, 0, 0, 0):
        raise ValueError("no 8-bit RGB image with a length")
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(size[1], 3 * size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return length, rows[:, 1:].tobytes()


class Writer(DataSourceArrowWriter):
    """Rows (doc_id, text as binary) to archives named by task and number."""

    def __init__(self, address: str, archive_bytes: int):
        self.address, self.archive_bytes, self.job = address, archive_bytes, f"tmp-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> files.Written:
        storage, folder = files.store(self.address)
        task = TaskContext.get()
        place = f"{folder}/{self.job}/{task.taskAttemptId()}"
        storage.create_dir(place)
        done, out, offsets, size = [], None, [], 0

        def close() -> None:
            nonlocal out, offsets, size
            if out is None:
                return
            out.write(b"\0" * (2 * BLOCK))
            out.close()
            with storage.open_output_stream(f"{place}/{name}{INDEX}") as index:
                index.write(np.array(offsets, "<i8").tobytes())
            done.append((f"{place}/{name}", name, {"bytes": size + 2 * BLOCK, "members": len(offsets)}))
            out, offsets, size = None, [], 0

        for batch in iterator:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{len(done):04d}.tar"
                    out = storage.open_output_stream(f"{place}/{name}")
                media = encode(text.as_py() or b"")
                entry = tarfile.TarInfo(f"{doc_id.as_py() if doc_id.is_valid else 'null'}.png")
                entry.size = len(media)
                offsets.append(size)
                member = entry.tobuf(tarfile.USTAR_FORMAT) + media + b"\0" * (-len(media) % BLOCK)
                out.write(member)
                size += len(member)
                if size >= self.archive_bytes:
                    close()
        close()
        return files.Written(done)

    def commit(self, messages) -> None:
        files.commit(self.address, self.job, messages, INDEX)

    def abort(self, messages) -> None:
        files.discard(self.address, self.job)


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    stop: int


def member(open_file: Callable, offset: int, held: list, tries: int = TRIES) -> tuple[str, bytes, int, bytes]:
    """(name, media, length, samples) of the member at ``offset``.

    ``held`` keeps the open file. Whatever fails - opening, reading, the header's
    checksum, the image's - closes it and the member is read anew, ``tries``
    times in all; then the last error goes up.
    """
    for attempt in range(tries):
        try:
            if not held:
                held.append(open_file())
            held[0].seek(offset)
            entry = tarfile.TarInfo.frombuf(held[0].read(BLOCK), "utf-8", "surrogateescape")
            media = held[0].read(entry.size)
            return entry.name, media, *decode(media)
        except Exception:
            for file in held:
                file.close()
            held.clear()
            if attempt + 1 == tries:
                raise
    raise ValueError("tries must be positive")


class Reader(DataSourceReader):
    def __init__(self, address: str, range_bytes: int):
        self.address, self.range_bytes = address, range_bytes

    def partitions(self) -> list[ByteRange]:
        ranges = [
            ByteRange(f["file"], start, start + self.range_bytes)
            for f in files.manifest(self.address) for start in range(0, f["bytes"], self.range_bytes)
        ]
        return ranges or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        storage, folder = files.store(self.address)
        path = f"{folder}/{partition.file}"
        with storage.open_input_stream(path + INDEX) as index:
            offsets = np.frombuffer(index.readall(), "<i8")
        own = offsets[np.searchsorted(offsets, partition.start):np.searchsorted(offsets, partition.stop)]
        held: list = []
        rows: list[tuple] = []
        size = 0
        for offset in own.tolist():
            name, media, length, samples = member(lambda: storage.open_input_file(path), offset, held)
            stem = name.removesuffix(".png")
            rows.append((None if stem == "null" else int(stem), length, media, samples))
            size += len(media) + len(samples)
            if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)
        for file in held:
            file.close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.record_batch(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
        ["doc_id", "n_bytes", "media", "payload"],
    )


class ImageArchive(DataSource):
    """``spark.read.format("image_archive").load(folder)``, and ``write`` alike.

    Options: ``archiveBytes`` (roll-over size when writing) and ``rangeBytes``
    (bytes of an archive that one task reads).
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("archiveBytes", ARCHIVE_BYTES)))


@arrow_udf(StringType())
def feature(payload: pa.Array) -> pa.Array:
    """Mean and deviation of the samples and a 64-bit profile of the image columns:
    which pixels are brighter than the middle one, over all rows."""
    out = []
    for value in payload:
        samples = np.frombuffer(value.as_buffer(), np.uint8).reshape(-1, PIXELS, 3)
        profile = samples.sum(axis=(0, 2), dtype=np.int64)
        bits = np.packbits(profile > np.median(profile))
        out.append(f"{samples.mean():.4f}:{samples.std():.4f}:{bits.tobytes().hex()}")
    return pa.array(out, pa.string())


def write(documents: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", **options) -> None:
    """Writes every whole text as an archive member; NULL texts are empty."""
    documents.sparkSession.dataSource.register(ImageArchive)
    rows = pick(documents, doc_id=id_col, text=text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    rows.write.format(FORMAT).mode("append").options(**options).save(folder)


def read(spark, folder: str, **options) -> DataFrame:
    """doc_id, n_bytes, media (the stored form) and payload (the samples read back)."""
    spark.dataSource.register(ImageArchive)
    return spark.read.format(FORMAT).options(**options).load(folder)


def digests(media: DataFrame) -> DataFrame:
    """Lengths, checksums and feature of what ``read`` returns.

    One row per member, repeated rows and NULL ids included; equal texts have
    equal values; an empty folder gives an empty table.
    """
    payload, stored = F.col("payload"), F.col("media")
    return media.select(
        "doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length(stored).cast("long").alias("media_bytes"), F.sha2(stored, 256).alias("media_sha256"),
        feature(payload).alias("feature"),
    )


def round_trip(documents: DataFrame, **columns) -> DataFrame:
    """Digests of all documents after writing them to a new folder and reading it."""
    spark = documents.sparkSession
    folder = files.new_folder(spark, "media")
    write(documents, folder, **columns)
    return digests(read(spark, folder))
