"""Distinct-word BPE against the tiktoken library, text by text."""

import hashlib
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

import __spark_entry__ as entry
from webstrata.llm import wordbpe

ENCODING = tiktoken.Encoding(
    "test", pat_str=public_tokenizers.PATTERN, special_tokens={},
    mergeable_ranks=wordbpe.read_ranks(public_tokenizers.path(wordbpe.RANKS)),
)
ODD = [
    None, "", " ", "  a", "a  b ", "a \n b\n\n\nc", "it's we'll DON'T", "tab\tx \ty", "<|endoftext|> a", "é ü 日本 語 🎉",
    "12345 67!! ??? #$% a_b", "\x00 \x1c fs \x85 nel ​", "a" * 3000, "word " * 3000, "١٢ ǅ",
]


def ids(text):
    return np.array(ENCODING.encode_ordinary(text or ""), "<u4").tobytes()


def digest(value):
    return hashlib.sha256(value).hexdigest()


@pytest.mark.parametrize("options", [{}, {"block_words": 50}, {"block_words": 1}])
def test_ids_equal_the_library(spark, docs, options):
    texts = ODD + ODD[:6]
    frame = docs([(i % 12 if i else None, t, "en", "s") for i, t in enumerate(texts)]).repartition(3)
    got = wordbpe.encode(frame, **options).collect()
    want = [(i % 12 if i else None, ids(t)) for i, t in enumerate(texts)]
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(i), v) for i, v in want)


def test_query_on_a_whole_table(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = entry.queries()["op11_distinct_word_bpe"](spark, folder).collect()
    assert {tuple(r) for r in got} == {
        (i, len(ids(t)) // 4, digest(ids(t)), digest((t or "").encode())) for i, t in texts.items()
    }
    assert len(got) == len(texts)


def test_very_long_runs(spark, docs):
    # The library's own splitter cannot take these; a run is one match and is merged as such.
    texts = [" " * 1_000_000, "\n" * 1_000_000, "a" + " " * 1_200_000 + "b", "x y " * 300_000]
    got = {r.doc_id: r for r in wordbpe.round_trip(docs([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert got[i].decoded_sha256 == digest(t.encode())
    assert got[0].ids_sha256 == digest(np.array(ENCODING._encode_single_piece(texts[0]), "<u4").tobytes())


def test_words_reach_the_merge_once(spark):
    rows = spark.range(400).selectExpr("id AS doc_id", "concat('alpha beta ', id % 7) AS text").repartition(8)
    seen = wordbpe.encode(rows, block_words=5)
    assert {bytes(r.ids) for r in seen.collect()} == {ids(f"alpha beta {i}") for i in range(7)}


def test_decode(spark):
    rows = [(1, ids("some text")), (1, ids("some text")), (2, b""), (None, None)]
    got = wordbpe.decode(spark.createDataFrame(rows, "doc_id long, ids binary")).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in got) == [
        ("1", b"some text"), ("1", b"some text"), ("2", b""), ("None", b""),
    ]
    with pytest.raises(Exception, match="60000"):
        bad = np.array([60000], "<u4").tobytes()
        wordbpe.decode(spark.createDataFrame([(1, bad)], "doc_id long, ids binary")).collect()


def test_numbers_round_trip():
    r = np.random.default_rng(0)
    edges = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 2**28, 2**32 - 1], np.uint32)
    for numbers in (np.zeros(0, np.uint32), edges, np.arange(5, dtype=np.uint32), r.integers(0, 2**32, 1000, np.uint32)):
        assert (wordbpe.unpack_numbers(wordbpe.pack_numbers(numbers)) == numbers).all()


def test_empty(spark, docs):
    assert wordbpe.round_trip(docs([])).count() == 0
    assert wordbpe.round_trip(docs([])).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_blocks_are_packed_and_rebuilt_in_bounded_steps(monkeypatch):
    """Work arrays have the size of a step, not of a block; batches split anywhere give the same ids."""
    numbers = np.random.default_rng(1).integers(0, 1 << 20, 3_000_000, np.uint32)

    def peak(work):
        tracemalloc.start()
        out = work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most

    packed, most = peak(lambda: wordbpe.pack_numbers(numbers))
    assert most < 3.5 * numbers.nbytes
    back, most = peak(lambda: wordbpe.unpack_numbers(packed))
    assert most < 3.5 * numbers.nbytes and (back == numbers).all()

    monkeypatch.setattr(wordbpe, "STEP", 3)
    monkeypatch.setattr(wordbpe, "BATCH_IDS", 4)
    words = [[7, 300000], [], [1, 2, 3], [5]]  # ids of each word
    documents = [[], [0, 2], [3] * 7, [], [1, 1], [2, 0, 3, 0, 2], []]
    gaps, counts = np.array([0, 1, 2]), np.array([2, 0, 1])  # words 0, 1, 3; word 2 stands in another row
    pack = wordbpe.pack_numbers
    found = pa.table({
        "gaps": [pack(gaps), pack(np.array([2]))], "counts": [pack(counts), pack(np.array([3]))],
        "ids": [pack(np.array([7, 300000, 5])), pack(np.array([1, 2, 3]))],
    })
    blocks = pa.table({
        "keys": [list(range(len(documents)))], "ends": [np.cumsum([len(d) for d in documents]).tolist()],
        "positions": [pack(np.array([w for d in documents for w in d]))],
    })
    got = wordbpe._rebuild(blocks, found)
    assert got["key"].to_pylist() == list(range(len(documents)))
    assert got["ids"].to_pylist() == [np.array([i for w in d for i in words[w]], "<u4").tobytes() for d in documents]
    none = pa.table({c: pa.array([], pa.binary()) for c in ("gaps", "counts", "ids")})
    blank = pa.table({"keys": [[4, None]], "ends": [[0, 0]], "positions": [pack(np.zeros(0, np.uint32))]})
    assert wordbpe._rebuild(blank, none).to_pylist() == [{"key": 4, "ids": b""}, {"key": None, "ids": b""}]


def test_held_keys_do_not_keep_their_batch():
    block = wordbpe._Block()
    batch = pa.record_batch([pa.array(range(1000)), pa.array(["x" * 1000] * 1000)], ["key", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    read = pa.ipc.open_stream(sink.getvalue()).read_next_batch()
    block.hold(read.column(0), 2, 5)
    assert block.keys[0].to_pylist() == [2, 3, 4]
    assert block.keys[0].buffers()[1].address != read.column(0).buffers()[1].address
    assert block.keys[0].get_total_buffer_size() <= 64


def block_of(texts):
    block, split = wordbpe._Block(), wordbpe._splitter(public_tokenizers.PATTERN)
    for text in texts:
        block.sequence.extend(map(block.numbers.__getitem__, split(text)))
        block.ends.append(len(block.sequence))
    keys = pa.array(range(len(texts)), pa.int64())
    block.hold(keys, 0, len(keys))
    return block


def test_a_block_is_written_in_rows_of_bounded_size(monkeypatch):
    monkeypatch.setattr(wordbpe, "PIECE_BYTES", 2000)
    texts = [" ".join(f"w{(i * j) % 997}" for j in range(i % 50)) for i in range(300)]
    pieces = list(block_of(texts).pieces(3))
    assert len(pieces) > 5 and all(p.num_rows == 1 and p.nbytes < 2500 for p in pieces)
    words = [w for p in pieces for w in p["words"][0].as_py()]
    assert [p["first_word"][0].as_py() for p in pieces] == np.cumsum([0, *(len(p["words"][0]) for p in pieces)])[:-1].tolist()
    ids_of = [ENCODING._encode_single_piece(w.encode()) for w in words]
    found = pa.table({
        "gaps": [wordbpe.pack_numbers(np.r_[0, np.ones(len(words) - 1, int)])],
        "counts": [wordbpe.pack_numbers(np.array([len(i) for i in ids_of]))],
        "ids": [wordbpe.pack_numbers(np.concatenate(ids_of))],
    })
    # In whatever order the pieces arrive.
    got = wordbpe._rebuild_pieces(pa.Table.from_batches(pieces[1::2] + pieces[::2][::-1]), found)
    assert got["key"].to_pylist() == list(range(len(texts)))
    assert got["ids"].to_pylist() == [ids(t) for t in texts]


def test_writing_a_block_takes_less_than_the_block():
    words = np.random.default_rng(2).integers(0, 1000, 3_000_000, np.uint32)
    block = wordbpe._Block()
    for i in range(1000):
        block.numbers[f"w{i}"]
    block.sequence.frombytes(words.tobytes())
    block.ends.append(len(words))
    block.hold(pa.array([1]), 0, 1)
    tracemalloc.start()
    pieces = sum(p.num_rows for p in block.pieces(0))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pieces > 1 and most < 2 * words.nbytes


@pytest.mark.parametrize("step", [1, 2, 3, 1000])
def test_numbers_that_cross_steps(monkeypatch, step):
    monkeypatch.setattr(wordbpe, "STEP", step)
    numbers = np.array([0, 2**32 - 1, 2**28, 1, 2**21, 127, 128, 2**32 - 1], np.uint32)
    assert (wordbpe.unpack_numbers(wordbpe.pack_numbers(numbers)) == numbers).all()
    rank = np.array([300, 0, 2**31, 5], np.uint32)
    assert (wordbpe.unpack_numbers(wordbpe.pack_numbers(np.array([3, 2, 0, 0, 1], np.uint32), rank)) == [5, 2**31, 300, 300, 0]).all()


def test_texts_arrive_in_batches_of_bounded_bytes(spark, monkeypatch):
    real, before = wordbpe._explode, spark.conf.get(wordbpe.BATCH_CONF)
    monkeypatch.setattr(wordbpe, "BATCH_BYTES", 100_000)

    def watched(*options):
        run = real(*options)

        def checked(batches):
            def each():
                for batch in batches:
                    if batch.nbytes > 200_000:
                        raise ValueError(f"a batch of {batch.nbytes} bytes")
                    yield batch

            return run(each())

        return checked

    monkeypatch.setattr(wordbpe, "_explode", watched)
    rows = spark.range(500).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 1000) AS text").coalesce(1)
    assert wordbpe.encode(rows).count() == 500
    assert spark.conf.get(wordbpe.BATCH_CONF) == before


def test_decoded_texts_leave_in_short_batches(monkeypatch):
    monkeypatch.setattr(wordbpe, "STEP", 4)
    values = [ids("some text"), b"", ids("a b c d e f"), None, ids("x")]
    batch = pa.record_batch([pa.array(range(5)), pa.array(values, pa.binary())], ["key", "ids"])
    out = list(wordbpe._look_up(public_tokenizers.path(wordbpe.RANKS))(iter([batch, batch.slice(0, 0)])))
    assert [b.num_rows for b in out] == [3, 2]
    assert [k for b in out for k in b["key"].to_pylist()] == list(range(5))
    assert [v for b in out for v in b["decoded"].to_pylist()] == [b"some text", b"", b"a b c d e f", b"", b"x"]
