"""WARC archives: a deterministic sharded writer, and a reader.

Records are range-sorted by page: boundaries come from a sample of pages chosen
by hash of the id, so the same table gives the same shards whatever its
partitions. A shard is one task; it writes one gzip member per record and rolls
over to the next file at a compressed size. Headers, record ids and digests are
made anew from the data. Tasks write under temporary names; the driver renames
the files of the attempts that count and then writes a manifest, which is all
that a reader trusts. Of equal payloads the least page is a ``response``, the
others are ``revisit`` records that name it.

Writing goes through ``pyarrow.fs``; reading through Spark's ``binaryFile``.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import IntegerType

from webstrata.llm import files
from webstrata.llm.shared import pick

FORMAT = "warc_archive"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Uncompressed bytes of a shard, compressed bytes of a file, sampled ids per shard.
SHARD_BYTES, FILE_BYTES, SAMPLE = 64 << 20, 16 << 20, 256
#: Ids that shard ends are chosen from, at most.
MOST_SAMPLED = 1 << 20
LEVEL = 6
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, payload_digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{payload_digest}|{nth}')}>"


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(
    page_id: int | None, url: str | None, payload: bytes, first: tuple[int | None, str | None] | None,
    nth: int = 0, date: str = DATE,
) -> bytes:
    """One WARC record. ``first``: page and address of the response that a revisit
    names; ``nth`` tells repeated rows apart."""
    hashed = digest(payload)
    http = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        b"Content-Length: %d\r\n\r\n" % len(payload)
    )
    block = http + (payload if first is None else b"")
    head = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, hashed, nth)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _clean(url)),
        ("X-Page-ID", None if page_id is None else str(page_id)),
    ]
    if first is not None:
        head += [
            ("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(first[0], hashed, 0)),
            ("WARC-Refers-To-Target-URI", None if first[1] is None else _clean(first[1])),
            ("X-Refers-To-Page-ID", None if first[0] is None else str(first[0])),
        ]
    head += [
        ("WARC-Payload-Digest", f"sha1:{hashed}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What a record says, after checking its block digest (and a response's payload)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
    hashed = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (digest(payload) != hashed or len(payload) != length):
        raise ValueError("payload digest differs")

    def number(name: str) -> int | None:
        return int(fields[name]) if name in fields else None

    return {
        "page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": length,
        "payload_digest": hashed, "record_type": fields["WARC-Type"],
        "refers_to": None if response else number("X-Refers-To-Page-ID"),
        "payload": payload if response else None,
    }


class Writer(DataSourceArrowWriter):
    """Sorted rows (shard, page_id, sha, mark, url, html, first_id, first_url) to files.

    A row with ``mark`` says where the payload of the rows behind it, those with
    its page_id and sha, is first found; it makes no record.
    """

    def __init__(self, address: str, file_bytes: int, date: str):
        self.address, self.file_bytes, self.date = address, file_bytes, date
        self.job = f"tmp-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> files.Written:
        storage, folder = files.store(self.address)
        place = f"{folder}/{self.job}/{TaskContext.get().taskAttemptId()}"
        storage.create_dir(place)
        done, out, before, marked = [], None, None, None
        shard = size = count = number = nth = 0
        sha = hashlib.sha1()

        def close() -> None:
            nonlocal out, size, count, number, sha
            if out is not None:
                out.close()
                done.append((f"{place}/{name}", name, {"bytes": size, "records": count, "sha1": sha.hexdigest()}))
                number += 1
            out, size, count, sha = None, 0, 0, hashlib.sha1()

        for batch in iterator:
            for row in zip(*batch.columns, strict=True):
                own, page_id, sha2, mark, url, html, first_id, first_url = (x.as_py() for x in row)
                if mark:
                    marked = (page_id, sha2), (first_id, first_url)
                    continue
                if out is not None and own != shard:
                    close()
                if own != shard:
                    shard, number = own, 0
                key = (page_id, sha2)
                nth = nth + 1 if key == before else 0
                before = key
                first = marked[1] if marked and marked[0] == key else None
                if first and first[0] == page_id and not nth:
                    first = None
                data = record(page_id, url, html, first, nth, self.date)
                packed = gzip.compress(data, LEVEL, mtime=0)
                if out is None:
                    name = f"shard-{shard:06d}-{number:04d}.warc.gz"
                    out = storage.open_output_stream(f"{place}/{name}", compression=None)
                out.write(packed)
                sha.update(packed)
                size += len(packed)
                count += 1
                if size >= self.file_bytes:
                    close()
        close()
        return files.Written(done)

    def commit(self, messages) -> None:
        files.commit(self.address, self.job, messages)

    def abort(self, messages) -> None:
        files.discard(self.address, self.job)


class WarcArchive(DataSource):
    """Sink only; options ``fileBytes`` and ``date``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "page_id long"

    def writer(self, schema, overwrite: bool) -> Writer:
        options = self.options
        return Writer(options["path"], int(options.get("fileBytes", FILE_BYTES)), options.get("date", DATE))


def _boundaries(pages: DataFrame, shard_bytes: int) -> list[int]:
    """Lower ends of all shards but the first; the same for the same table."""
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    sample = (
        pages.where("page_id IS NOT NULL").select("page_id")
        .orderBy(F.xxhash64("page_id"), "page_id").limit(min(SAMPLE * shards, MOST_SAMPLED))
    )
    ids = sorted(r["page_id"] for r in sample.collect()) if shards > 1 else []
    return sorted({ids[len(ids) * i // shards] for i in range(1, shards)}) if ids else []


def write(
    pages: DataFrame, folder: str, least_bytes: int = 0, shard_bytes: int = SHARD_BYTES,
    file_bytes: int = FILE_BYTES, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> None:
    """Writes one record per row.

    NULL pages have an empty payload, NULL addresses no target header. Payloads
    below ``least_bytes`` are all responses. Of repeated rows (id and payload)
    the first is the response; rows with a NULL id come first in the archive and
    are a response only where no row with an id has the payload. An empty table
    gives an empty manifest.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcArchive)
    rows = pick(pages, page_id=id_col, url=url_col, html=html_col).select(
        "page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html")
    )
    bounds = np.array(_boundaries(rows, shard_bytes), np.int64)

    @arrow_udf(IntegerType())
    def shard_of(ids: pa.Array) -> pa.Array:
        own = np.searchsorted(bounds, ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), "right")
        return pa.array(own.astype(np.int32))

    hashed = rows.withColumn("sha", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url"))
    heads = (
        hashed.where(F.col("size") >= least_bytes).groupBy("sha", "size")
        .agg(F.count("*").alias("n"), least.alias("first")).where("n > 1")
        .select("sha", "size", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    )
    # Only ids and hashes meet the heads; their verdicts travel beside the pages
    # in the one shuffle that moves page texts.
    marks = (
        hashed.select("page_id", "sha", "size").distinct().join(heads, ["sha", "size"])
        .select("page_id", "sha", F.lit(True).alias("mark"), "first_id", "first_url")
    )
    both = hashed.drop("size").withColumn("mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    placed = both.withColumn("shard", shard_of("page_id")).repartitionById(len(bounds) + 1, "shard")
    placed.sortWithinPartitions(
        "shard", F.asc_nulls_first("page_id"), "sha", F.desc("mark"), "url"
    ).select(
        "shard", "page_id", "sha", "mark", "url", "html", "first_id", "first_url"
    ).write.format(FORMAT).mode("append").options(fileBytes=file_bytes, date=date).save(folder)


def _records(data: bytes) -> Iterator[bytes]:
    """Gzip members of an archive, one at a time."""
    source = io.BytesIO(data)
    unzip = zlib.decompressobj(31)
    rest, out = source.read(1 << 20), []
    while rest:
        out.append(unzip.decompress(rest))
        if unzip.eof:
            yield b"".join(out)
            rest, out = unzip.unused_data or source.read(1 << 20), []
            unzip = zlib.decompressobj(31)
        else:
            rest = source.read(1 << 20)
    if out:
        raise ValueError("the archive ends inside a record")


_FIELDS = {
    "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(),
}


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            held, size = [], 0
            for data in _records(content.as_py()):
                held.append(parse(data))
                size += len(data)
                if size >= 8 << 20:
                    yield _rows(held)
                    held, size = [], 0
            if held:
                yield _rows(held)


def _rows(held: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in held], kind) for k, kind in _FIELDS.items()], list(_FIELDS))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    Every file of the manifest is read; digests are checked. A revisit's payload
    is NULL, its length and digest are those of the full payload.
    """
    names = [f"{folder}/{f['file']}" for f in files.manifest(folder)]
    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, payload binary"
    )
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.format("binaryFile").load(names).select("content").mapInArrow(_unpack, schema)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """What the archives of all pages say: one row per page, without the payload."""
    folder = files.new_folder(pages.sparkSession, "warc")
    write(pages, folder, **options)
    return read(pages.sparkSession, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
