"""Exact round trips of image archives and WARC files, with faults on the way."""

import base64
import gzip
import hashlib
import io
import json
import tarfile
import zlib

import pyarrow as pa
import pytest
from pyarrow import fs

from webstrata.llm import files, media, warc

TEXTS = [None, "", "a", "x" * 192, "y" * 193, "é\n\t" * 500, "z" * 200_000, "a"]


def test_round_trip(spark, docs):
    rows = [(i, t, None, None) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None), (0, "twice", None, None)]
    got = media.round_trip(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_bytes): r for r in got}
    for i, text, *_ in rows:
        data = (text or "").encode()
        whole = data + b" " * ((-len(data)) % 192 or (0 if data else 192))
        r = by[i, len(data)]
        assert r.payload_bytes == len(whole) and r.payload_bytes % 192 == 0
        assert r.payload_sha256 == hashlib.sha256(whole).hexdigest()
        assert r.tail_crc32 == zlib.crc32(whole[-16:])
    assert by[2, 1][1:] == by[7, 1][1:] and by[0, 0][1:] == by[1, 0][1:]


def test_archives_roll_and_ranges_cover_every_member(spark, docs):
    rows = [(i, f"text {i} " * 40, None, None) for i in range(300)]
    folder = files.new_folder(spark, "test")
    media.write(docs(rows).repartition(3), folder, archiveBytes=20_000)
    listed = files.manifest(folder)
    assert len(listed) > 6 and sum(f["members"] for f in listed) == 300
    storage, path = files.store(folder)
    assert not any(".tmp" in f.path or "tmp-" in f.base_name for f in storage.get_file_info(fs.FileSelector(path)))
    with storage.open_input_stream(f"{path}/{listed[0]['file']}") as file:
        names = tarfile.open(fileobj=io.BytesIO(file.readall())).getnames()
    assert len(names) == listed[0]["members"]
    read = media.read(spark, folder, rangeBytes=3_000)
    assert read.rdd.getNumPartitions() > 20
    assert sorted((r.doc_id, bytes(r.payload).rstrip().decode()) for r in read.collect()) == [
        (i, (f"text {i} " * 40).rstrip()) for i in range(300)
    ]


def test_a_member_is_read_again_by_offset():
    image = media.encode(b"hello")
    entry = tarfile.TarInfo("7.png")
    entry.size = len(image)
    archive = b"\0" * 512 + entry.tobuf(tarfile.USTAR_FORMAT) + image
    opened = []

    def flaky():
        opened.append(1)
        data = archive if len(opened) > 2 else archive[:-3] + b"???"
        return pa.BufferReader(data)

    held = []
    assert media.member(flaky, 512, held)[:3:2] == ("7.png", 5) and len(opened) == 3
    with pytest.raises(Exception):
        media.member(lambda: pa.BufferReader(b"\1" * 2000), 512, [])


def test_damaged_images_are_refused():
    image = bytearray(media.encode(b"hello" * 100))
    image[60] ^= 1
    with pytest.raises(ValueError):
        media.decode(bytes(image))


def test_empty_media(spark, docs):
    assert media.round_trip(docs([])).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", 1) for r in rows], "page_id long, url string, html string, sha string, shard int"
    )


PAGES = [
    (5, "http://a/5", "same"), (3, "http://a/3", "same"), (9, None, "same"), (1, "http://a/1\r\nX: y", ""),
    (2, "http://a/2", None), (7, "http://a/7", "é" * 3000), (8, "http://a/8", "x\r\n\r\ny"), (3, "http://a/3", "same"),
    (None, "http://n", "same"), (None, "http://n", "only"), (None, "http://n", "only"), (-4, "u", "neg"),
]


def test_warc_round_trip(spark):
    got = warc.round_trip(pages(spark, PAGES)).collect()

    def facts(page_id, html, kind, to):
        data = (html or "").encode()
        return (page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, to)

    want = [
        facts(5, "same", "revisit", 3), facts(3, "same", "response", None), facts(9, "same", "revisit", 3),
        facts(1, "", "response", None), facts(2, None, "revisit", 1), facts(7, "é" * 3000, "response", None),
        facts(8, "x\r\n\r\ny", "response", None), facts(3, "same", "revisit", 3), facts(None, "same", "revisit", 3),
        facts(None, "only", "response", None), facts(None, "only", "revisit", None), facts(-4, "neg", "response", None),
    ]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_small_payloads_are_responses(spark):
    folder = files.new_folder(spark, "test")
    warc.write(pages(spark, PAGES), folder, least_bytes=5)
    assert {r.record_type for r in warc.read(spark, folder).collect()} == {"response"}


def test_payload_and_headers_come_back(spark):
    folder = files.new_folder(spark, "test")
    warc.write(pages(spark, [PAGES[6], PAGES[3]]), folder)
    got = {r.page_id: r for r in warc.read(spark, folder).collect()}
    assert bytes(got[8].payload) == b"x\r\n\r\ny" and got[1].url == "http://a/1%0D%0AX: y"


def archive(spark, frame, **options):
    folder = files.new_folder(spark, "test")
    warc.write(frame, folder, **options)
    storage, path = files.store(folder)
    out = {}
    for f in files.manifest(folder):
        with storage.open_input_stream(f"{path}/{f['file']}", compression=None) as file:
            out[f["file"]] = file.readall()
        assert hashlib.sha1(out[f["file"]]).hexdigest() == f["sha1"] and len(out[f["file"]]) == f["bytes"]
    return out


def test_archives_do_not_depend_on_partitions(spark):
    rows = [(i * 37 % 1000 - 300, f"http://h/{i}", f"<p>{i % 90}</p>" * 50) for i in range(400)]
    options = {"shard_bytes": 40_000, "file_bytes": 4_000}
    first = archive(spark, pages(spark, rows).repartition(3), **options)
    second = archive(spark, pages(spark, rows[::-1]).repartition(8), **options)
    assert first == second and len(first) > 5
    shards = {}
    for name in sorted(first):
        for record in gzip.decompress(first[name]).split(b"WARC/1.1\r\n")[1:]:
            shards.setdefault(name[:12], []).append(int(record.split(b"X-Page-ID: ")[1].split(b"\r")[0]))
    order = [i for name in sorted(shards) for i in shards[name]]
    assert order == sorted(order) and len(order) == 400 and len(shards) > 1


def test_a_half_written_archive_is_not_readable(spark, tmp_path):
    writer = warc.Writer(str(tmp_path), 100, warc.DATE)
    (tmp_path / writer.job).mkdir()
    (tmp_path / writer.job / "left").write_text("x")
    with pytest.raises(FileNotFoundError):
        warc.read(spark, str(tmp_path))
    writer.commit([None])
    assert json.loads((tmp_path / files.MANIFEST).read_text()) == {"files": []}
    assert warc.read(spark, str(tmp_path)).count() == 0 and not (tmp_path / writer.job).exists()


def test_damaged_records_are_refused():
    data = bytearray(warc.record(1, "u", b"payload", None))
    data[-8] ^= 1
    with pytest.raises(ValueError):
        warc.parse(bytes(data))
    with pytest.raises(ValueError):
        list(warc._records(gzip.compress(b"x" * 100)[:-9]))


def test_empty_warc(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
