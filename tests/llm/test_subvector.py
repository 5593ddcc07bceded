"""k-means over subvector dictionaries against plain integer arithmetic."""

import hashlib
import math
import random

import pytest

from webstrata.llm import subvector


def slow(rows, k, rounds, dimensions, scale=256, seed=2):
    """(id, cluster, distance, cluster inertia, inertia, digest) by the definition, in Python integers."""
    kept = [
        (i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        of = [c for c, _ in assign()]
        for c in set(of):
            own = [v for (_, v), o in zip(kept, of) if o == c]
            centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    final = assign()
    total = sum(d for _, d in final)
    return sorted(
        (str(i), c, d, sum(e for o, e in final if o == c), total,
         hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for (i, _), (c, d) in zip(kept, final)
    )


def got(df):
    return sorted((str(r.vec_id), *tuple(r)[1:]) for r in df.collect())


def make(spark, rows, kind="float"):
    full = [(i, v, "x", i, "y") for i, v in rows]
    return spark.createDataFrame(full, f"vec_id long, embedding array<{kind}>, cluster string, id long, distance string")


@pytest.mark.parametrize("width,slice_rows", [(2, 16_384), (3, 7), (1, 1), (8, 50)])
def test_equals_the_definition(spark, width, slice_rows):
    r = random.Random(width)
    rows = [(i, [r.randrange(-64, 64) / 128 for _ in range(8)]) for i in range(150)]
    rows += rows[:5] + [(3, [0.5] * 8), (None, [0.25] * 8)]  # repeated rows, an id with two vectors, no id
    rows += [(900, None), (901, [0.1] * 7), (902, [None] + [0.1] * 7), (903, [float("nan")] * 8), (904, [float("inf")] * 8)]
    df = subvector.cluster(make(spark, rows).repartition(4), k=10, rounds=3, dimensions=8, width=width, slice_rows=slice_rows)
    assert got(df) == slow(rows, 10, 3, 8)


def test_ties_and_empty_clusters(spark):
    # Three of the first centroids agree, so two of them stay empty.
    rows = [(i, [0.5, 0.5]) for i in range(6)] + [(i, [-0.5, 0.25 * i]) for i in range(6, 9)]
    df = subvector.cluster(make(spark, rows), k=5, rounds=2, dimensions=2)
    assert got(df) == slow(rows, 5, 2, 2)


def test_components_beyond_64_bits(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) * 10.0 ** r.choice([0, 6, 30]) for _ in range(4)]) for i in range(30)]
    want = slow(rows, 4, 2, 4)
    have = got(subvector.cluster(make(spark, rows, "double"), k=4, rounds=2, dimensions=4))
    fits = lambda x: x if x < 2**63 else None
    assert have == [(i, c, fits(d), fits(s), fits(t), h) for i, c, d, s, t, h in want]


def test_fewer_vectors_than_clusters(spark):
    rows = [(7, [0.5, 0.25]), (8, [0.125, -0.5])]
    assert got(subvector.cluster(make(spark, rows), k=40, dimensions=2)) == slow(rows, 40, 5, 2)


def test_empty(spark):
    empty = subvector.cluster(make(spark, [(1, None)]))
    assert empty.count() == 0 and empty.columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256",
    ]


def test_a_slice_is_bounded(spark):
    with pytest.raises(ValueError):
        subvector.cluster(make(spark, []), slice_rows=1 << 17)
