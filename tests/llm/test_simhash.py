"""SimHash groups against all-pairs comparison, and the components below them."""

import random

import numpy as np
import pytest
import xxhash

from webstrata.llm import simhash
from webstrata.llm.components import components


def slow_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    if not words:
        return 0
    runs = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(codes, radius=3):
    """Least position of every position's group, by comparing all pairs."""
    label = list(range(len(codes)))
    changed = True
    while changed:
        changed = False
        for i in range(len(codes)):
            for j in range(i):
                if (codes[i] ^ codes[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def near_codes(seed, clusters=6, size=25):
    r = random.Random(seed)
    out = []
    for _ in range(clusters):
        code = r.getrandbits(64)
        for _ in range(size):
            out.append(code)
            for _ in range(r.choice([1, 2, 3, 4, 5, 9])):
                code ^= 1 << r.randrange(64)
    return list(dict.fromkeys(out + [0, (1 << 64) - 1, 1 << 63, 7]))


def test_fingerprint_matches_definition(spark):
    texts = [None, "", " \t\n", "One", "a B", "A b C", "é É x y z z", "w " * 3000, "x" * 10_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", simhash.fingerprint_hex(simhash.fingerprint_column(rows.t)).alias("f")).collect()
    assert {r.i: r.f for r in got} == {i: f"{slow_fingerprint(t):016x}" for i, t in enumerate(texts)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_forest_finds_every_link(seed):
    codes = near_codes(seed)
    forest = simhash.BKForest(np.array(codes, np.uint64), np.zeros(len(codes), np.int64))
    got = {tuple(sorted(p)) for a, b in forest.links(3) for p in zip(a.tolist(), b.tolist())}
    want = {
        (i, j) for j in range(len(codes)) for i in range(j) if (codes[i] ^ codes[j]).bit_count() <= 3
    }
    assert got == want


@pytest.mark.parametrize("levels,shard_rows", [(1, 1024), (1, 4), (2, 1024), (2, 3)])
def test_shards_lose_no_link(spark, levels, shard_rows):
    codes = near_codes(7)
    table = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long")
    dealt = simhash.shards(table, 3, levels, shard_rows).collect()
    together = {}
    for r in dealt:
        together.setdefault((r["shard"], r["part"]), set()).add(r["code"] & (2**64 - 1))
    met = {frozenset((a, b)) for s in together.values() for a in s for b in s if a < b}
    for i, a in enumerate(codes):
        for b in codes[:i]:
            assert (a ^ b).bit_count() > 3 or frozenset((a, b)) in met


@pytest.mark.parametrize("shard_rows", [1024, 5])
def test_groups_match_all_pairs(spark, shard_rows):
    codes = near_codes(11)
    table = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long")
    got = {r["code"] & (2**64 - 1): r["label"] for r in simhash.near_groups(table, 3, shard_rows).collect()}
    label = groups(codes)
    classes = {}
    for c, g in zip(codes, label):
        classes.setdefault(g, set()).add(c)
    found = {}
    for c, g in got.items():
        found.setdefault(g, set()).add(c)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, found.values()))


def sample_rows():
    r = random.Random(5)
    words = ["".join(r.choices("abcdefg", k=4)) for _ in range(200)]
    base = " ".join(r.choices(words, k=400))
    near = base.replace(" ", "  ", 3) + " tail"
    other = [" ".join(r.choices(words, k=r.randrange(1, 90))) for _ in range(25)]
    texts = [None, "", "  ", base, base.upper(), near, base, *other, other[3]]
    return [(i + 10, t, "en", "s") for i, t in enumerate(texts)] + [(None, base, None, None), (12, "", "en", "s")]


def test_near_duplicates(spark, docs):
    rows = sample_rows()
    got = simhash.near_duplicates(docs(rows)).collect()
    codes = [slow_fingerprint(t) for _, t, _, _ in rows]
    label = groups(codes)
    least = {}
    for (i, *_), g in zip(rows, label):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted((str(i), f"{c:016x}", least[g]) for (i, *_), c, g in zip(rows, codes, label))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_keep_one_keeps_one_row_of_each_group(spark, docs):
    rows = [*sample_rows(), sample_rows()[3]]
    frame = docs(rows)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    got = [r.doc_id for r in kept.collect()]
    label = groups([slow_fingerprint(t) for _, t, _, _ in rows])
    least = {}
    for (i, *_), g in zip(rows, label):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    assert sorted(got) == sorted(least.values())


def test_empty(spark, docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.keep_one(docs([])).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 5), (7, 3)]
    r.shuffle(edges)
    got = {x.node: x.label for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 160)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
