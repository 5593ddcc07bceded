"""Packing: tokens against the tokenizer, places against the definition."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from webstrata.llm import packing
from webstrata.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


ODD = [
    "", " ", "  a", "a  b", "a \n b", "a\n b\n\nc", "it's we'll  x", " lead", "trail ", "tab\tx \ty", "<|endoftext|> a",
    "x<|endoftext|>y z", "é ü   q", " em space", "1234 56!! ??? #$% a_b", "\x1c fs \x85 nel", "日本 語 🎉 ok",
    "don't 'tis  ", "a " * 500, "ab" * 3000,
]


def test_encoder_equals_tokenizers(spark, folder):
    tokenizer, encoder = Tokenizer.from_file(PATH), Encoder(PATH)
    texts = ODD + [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, text[:80]


def test_encoder_takes_long_white_space():
    tokenizer, encoder = Tokenizer.from_file(PATH), Encoder(PATH)
    for text in (" " * 1_000_000, "\n" * 1_000_000, "a" + " " * 1_000_000 + "b", "x \t" * 300_000):
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        assert encoder.encode(text) == want.tobytes()


def test_encoder_of_another_kind():
    path = public_tokenizers.path("word_bpe_49k.json")
    text = "Some Words, and MORE words"
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(Encoder(path).encode(text), "<u4").tolist() == want


@pytest.mark.parametrize("tokens,want", [
    (1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)]), (19, [(0, 3), (3, 8), (11, 8)]),
])
def test_cut(tokens, want):
    assert packing.cut(tokens, 8) == want


def test_fullest_is_the_best_subset():
    r = random.Random(1)
    for _ in range(200):
        counts = {r.randrange(1, 12): r.randrange(1, 4) for _ in range(r.randrange(1, 6))}
        room = r.randrange(0, 40)
        sums = {0}
        for length, copies in counts.items():
            sums = {s + length * c for s in sums for c in range(copies + 1)}
        chosen = packing.fullest(counts, room)
        assert all(c <= counts[x] for x, c in chosen)
        assert sum(x * c for x, c in chosen) == max(s for s in sums if s <= room)


def test_plan_places_every_piece_once():
    r = random.Random(2)
    for _ in range(30):
        histogram = {r.randrange(1, 65): r.randrange(1, 50) for _ in range(r.randrange(1, 30))}
        fill, seen = {}, {}
        for length, low, high, first, copies, offset in packing.plan(histogram, 64):
            for rank in range(low, high):
                seen[length] = seen.get(length, 0) + 1
                ahead, place = divmod(rank - low, copies)
                fill.setdefault(first + ahead, []).append((offset + place * length, length))
        assert seen == histogram
        for pieces in fill.values():
            end = 0
            for at, length in sorted(pieces):
                assert at == end
                end += length
            assert end <= 64
        total = sum(k * v for k, v in histogram.items())
        assert len(fill) <= 1.7 * -(-total // 64) + 1


def test_pack(spark, docs):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(["alpha", "beta", "gamma,", "x"], k=r.choice([0, 3, 40, 900, 4000]))), None, None)
            for i in range(120)]
    rows += [(500, None, None, None), (None, "no id", None, None), (3, "again", None, None), (3, "again", None, None)]
    rows += [(600 + i, t, None, None) for i, t in enumerate(ODD)]
    tokenizer = Tokenizer.from_file(PATH)
    got = packing.pack(docs(rows).repartition(5)).collect()
    want = []
    for i, text, *_ in rows:
        ids = ids_of(tokenizer, text)
        for piece, (start, length) in enumerate(packing.cut(len(ids), 2048)):
            crc = zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes())
            want.append((str(i), piece, start, length, crc))
    assert sorted((str(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in got) == sorted(want)
    fill = {}
    for x in got:
        fill.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for pieces in fill.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length
        assert end <= 2048
    assert len(fill) <= -(-sum(x.length for x in got) // 2048) + 1


def test_empty(spark, docs):
    assert packing.pack(docs([])).count() == 0
