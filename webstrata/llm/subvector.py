"""Exact k-means over integer vectors through dictionaries of subvectors.

The dimensions are cut into blocks of ``WIDTH``. A slice of vectors is stored
once, losslessly, as a dictionary of the distinct subvectors of every block and
one code per vector and block. A round then computes the exact distance of every
dictionary entry to every centroid's block once, and the distance of a vector is
the sum of these partial distances by its codes. New centroids come from code
counts: how often each dictionary entry occurs in each cluster, times the entry.

Dictionaries belong to a slice of at most ``SLICE`` vectors, so a task's memory is
bounded and nothing that grows with the data is broadcast. A round shuffles one
row per slice, cluster and dimension, summed on the map side; centroids (``k``
rows) travel with the task. All arithmetic is on integers: 64-bit while no
intermediate value can leave that range, Python integers beyond.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.shared import pick
from webstrata.session import cut_lineage

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
#: Dimensions of a block, and vectors of a slice.
WIDTH, SLICE = 2, 16_384
#: Components up to this size keep squared distances (64 dimensions) in 64 bits.
NARROW = 1 << 27
#: Sums are passed on in three parts of this many bits, so that they add up exactly in SQL.
LIMB = 50

_SLICES = "slice long, ids array<long>, dictionary array<array<string>>, codes array<binary>"


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers or, where one is too large, Python integers."""
    floors = np.floor(scale * values.astype(np.float64))
    if not floors.size or np.abs(floors).max() <= NARROW:
        return floors.astype(np.int64)
    return np.array([[int(v) for v in row] for row in floors], object).reshape(values.shape)


def _encode_slices(dimensions: int, scale: int, width: int, slice_rows: int):
    """Task: vectors to slices of dictionaries and codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, ids, rows = TaskContext.get().partitionId(), 0, [], []

        def sliced() -> pa.RecordBatch:
            matrix = _integers(np.concatenate(rows), scale)
            dictionary, codes = [], []
            for start in range(0, dimensions, width):
                block = matrix[:, start:start + width]
                keys = [",".join(map(str, r)) for r in block.tolist()]
                entries = sorted(set(keys))
                number = {e: i for i, e in enumerate(entries)}
                dictionary.append(entries)
                codes.append(np.fromiter(map(number.__getitem__, keys), np.uint16, len(keys)).tobytes())
            return pa.record_batch(
                [
                    pa.array([part << 32 | made], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                    pa.array([dictionary], pa.list_(pa.list_(pa.string()))), pa.array([codes], pa.list_(pa.binary())),
                ],
                ["slice", "ids", "dictionary", "codes"],
            )

        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            batch_ids, taken = batch.column(0).to_pylist(), 0
            while taken < len(batch_ids):
                room = min(slice_rows - len(ids), len(batch_ids) - taken)
                ids += batch_ids[taken:taken + room]
                rows.append(vectors[taken:taken + room])
                taken += room
                if len(ids) == slice_rows:
                    yield sliced()
                    made, ids, rows = made + 1, [], []
        if ids:
            yield sliced()

    return run


class _Slice:
    """One slice in memory: per block its distinct subvectors and the vectors' codes."""

    def __init__(self, dictionary: list[list[str]], codes: list[bytes]):
        entries = [[[int(v) for v in e.split(",")] for e in block] for block in dictionary]
        largest = max(abs(v) for block in entries for e in block for v in e)
        self.narrow = largest <= NARROW
        self.entries = [np.array(b, np.int64 if self.narrow else object) for b in entries]
        self.codes = [np.frombuffer(c, np.uint16) for c in codes]

    def assign(self, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid (the smaller number of equals) and squared distance of every vector."""
        narrow = self.narrow and max(abs(v) for c in centroids for v in c) <= NARROW
        kind = np.int64 if narrow else object
        means, total, start = np.array(centroids, kind), 0, 0
        for entries, codes in zip(self.entries, self.codes, strict=True):
            width = entries.shape[1]
            gaps = entries.astype(kind)[:, None, :] - means[None, :, start:start + width]
            partial = (gaps * gaps).sum(axis=2)  # each entry against each centroid, once
            total = total + partial[codes]
            start += width
        nearest = np.argmin(total, axis=1)
        return nearest, total[np.arange(len(nearest)), nearest]

    def sums(self, cluster: np.ndarray, k: int) -> tuple[np.ndarray, list[list[int]]]:
        """Vectors and exact component sums per cluster, from counts of codes."""
        columns = []
        for entries, codes in zip(self.entries, self.codes, strict=True):
            counts = np.bincount(cluster * len(entries) + codes, minlength=k * len(entries))
            columns.append(counts.reshape(k, len(entries)).astype(entries.dtype) @ entries)
        return np.bincount(cluster, minlength=k), np.concatenate(columns, axis=1).tolist()


def _limbs(value: int) -> tuple[int, int, int]:
    mask = (1 << LIMB) - 1
    return value & mask, value >> LIMB & mask, value >> 2 * LIMB


def _sum_round(centroids: list[list[int]]):
    """Task: one row (cluster, dim, n, low, middle, high) per slice, non-empty cluster and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held = _Slice(row["dictionary"], row["codes"])
                counts, sums = held.sums(held.assign(centroids)[0], len(centroids))
                out = [
                    (c, d, int(counts[c]), *_limbs(v))
                    for c in np.flatnonzero(counts).tolist() for d, v in enumerate(sums[c])
                ]
                columns = zip(*out, strict=True)
                yield pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], _SUMS)

    return run


_SUMS = ["cluster", "dim", "n", "low", "middle", "high"]


def _assign_round(centroids: list[list[int]]):
    """Task: (vec_id, cluster, distance) of every vector; distance as decimal text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nearest, distance = _Slice(row["dictionary"], row["codes"]).assign(centroids)
                yield pa.record_batch(
                    [
                        pa.array(row["ids"], pa.int64()), pa.array(nearest, pa.int32()),
                        pa.array(list(map(str, distance.tolist())), pa.string()),
                    ],
                    ["vec_id", "cluster", "distance"],
                )

    return run


def slices(vectors: DataFrame, dimensions: int, scale: int, width: int, slice_rows: int) -> DataFrame:
    """Dictionaries and codes of the vectors (id, vector), written once for all rounds."""
    return cut_lineage(vectors.mapInArrow(_encode_slices(dimensions, scale, width, slice_rows), _SLICES))


def kept(
    embeddings: DataFrame, dimensions: int = DIMENSIONS, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(id, vector) of the vectors that take part: whole, finite, of the wanted length."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = pick(embeddings, id=id_col, vector=vector_col).withColumn("vector", F.col("vector").cast("array<double>"))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") == dimensions) & finite)


def cluster(
    embeddings: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE,
    seed: int = SEED, width: int = WIDTH, slice_rows: int = SLICE, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components become floor(scale * x). Vectors that are NULL, of another length,
    or hold a NULL or non-finite component take no part. The first centroids are
    the ``k`` vectors with the smallest sha256 of ``seed:id`` (all, if fewer);
    of equal ids the least vector counts first, NULL ids come last. Repeated rows
    are vectors of their own. Distances are exact at any size of components;
    distance, cluster_inertia and inertia are NULL where they exceed a long. An
    empty table gives an empty table; further columns play no part.
    """
    if not 0 < slice_rows <= 1 << 16:
        raise ValueError("a slice holds 1 to 65,536 vectors, since codes have 16 bits")
    spark, vectors = embeddings.sparkSession, kept(embeddings, dimensions, id_col, vector_col)
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = vectors.orderBy(named.asc_nulls_last(), "vector").limit(k).collect()  # k vectors
    if not first:
        return spark.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        )
    centroids = _integers(np.array([r["vector"] for r in first]), scale).tolist()
    table = slices(vectors, dimensions, scale, width, slice_rows)
    for _ in range(rounds):
        parts = table.select("dictionary", "codes").mapInArrow(
            _sum_round(centroids), ", ".join(f"{c} long" for c in _SUMS)
        )
        totals = parts.groupBy("cluster", "dim").agg(
            *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in _SUMS[2:]]
        )
        for row in totals.collect():  # k * dimensions rows
            value = int(row["low"]) + (int(row["middle"]) << LIMB) + (int(row["high"]) << 2 * LIMB)
            centroids[row["cluster"]][row["dim"]] = value // int(row["n"])
    assigned = cut_lineage(table.select("ids", "dictionary", "codes").mapInArrow(
        _assign_round(centroids), "vec_id long, cluster int, distance string"
    ))
    exact = F.expr("try_cast(distance AS decimal(38,0))")
    per_cluster = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum(exact).alias("s")).collect()}
    whole = None if None in per_cluster.values() else sum(map(int, per_cluster.values()))

    def as_long(value):
        return None if value is None or value >= 1 << 63 else int(value)

    final = spark.createDataFrame(
        [
            (c, as_long(s), as_long(whole), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
            for c, s in per_cluster.items()
        ],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return assigned.withColumn("distance", F.expr("try_cast(distance AS long)")).join(F.broadcast(final), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
