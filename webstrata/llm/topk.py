"""Exact top-k inner products by dual-tree search over cover trees.

Vectors and queries are indexed together: pivots, chosen farthest-first from a
bounded sample, are the top level, and every vector belongs to the cell of its
nearest pivot. A cell, cut into parts of bounded size, holds one cover tree of
its vectors and one of its queries. A node is a point with the radius that
covers all below it. For a query node (centre q, radius r) and a data node
(centre p, radius s) no inner product exceeds

    <q, p> + r |p| + s |q| + r s,

so the pair is pruned when this is below the worst k-th score that the node's
queries have so far. The search first meets the tree beside the queries, which gives
good k-th scores; then the other trees of every cell that the bound leaves.
Both sides are trees of bounded size, so no task grows with a cell. Data trees
stand together on shelves: a query tree is shuffled once to each shelf with a cell
that it needs, not to each tree, and no side is broadcast.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm.shared import pick
from webstrata.operators.meeting import meet
from webstrata.session import cut_lineage

K, SCALE = 5, 256
#: Vectors of one tree, points of one leaf, and how much a level's radius shrinks.
PART, LEAF, SHRINK = 4096, 128, 1.4
#: Queries of one leaf: small, since the worst of them decides what is pruned.
QUERY_LEAF = 8
#: Data leaves that a query leaf is scored against in one product.
LEAVES_AT_ONCE = 16
#: Sampled vectors that pivots are chosen from, and pivots at most.
SAMPLE, PIVOTS = 4096, 1024
#: Shelves for each core, and components of the vectors on a shelf at most (a tree at least).
SHELVES_PER_CORE, SHELF_VALUES = 3, 1 << 22
#: Inner products stay below this, so that they are exact 64-bit numbers.
LARGEST_SCORE = 1 << 62
_NONE = -(1 << 62)


@dataclass
class Tree:
    """A cover tree: the children of node i are nodes
    ``first[i]`` to ``first[i] + count[i]``; a leaf's points are
    ``low[i]`` to ``high[i]``. Points are ordered along the leaves."""

    ids: np.ndarray
    points: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    count: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _distances(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - center) ** 2).sum(axis=1), 0))


def build(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Cover tree by farthest-first nets.

    The children of a node are a net of its points: each further than the
    level's radius from the others (separation), every point within that radius
    of the nearest one (covering). The level's radius shrinks by ``SHRINK``; a
    net of more points than two leaves would have ends in leaves of its own.
    """
    order = np.argsort(ids, kind="stable")
    ids, points = ids[order], points[order].astype(np.float64)
    nodes: list[list] = []  # center, radius, first, count, low, high
    placed: list[np.ndarray] = []
    done = 0
    queue: list[tuple[int, np.ndarray]] = []

    def add(members: np.ndarray, center: np.ndarray) -> int:
        far = _distances(points[members], center)
        nodes.append([center, float(far.max()) if len(far) else 0.0, 0, 0, 0, 0])
        queue.append((len(nodes) - 1, members))
        return len(nodes) - 1

    if len(ids):
        add(np.arange(len(ids)), points[0])
    while queue:  # depth first, so that the points below a node are neighbours
        node, members = queue.pop()
        radius = nodes[node][1]
        if len(members) <= leaf or radius == 0:
            nodes[node][4:6] = done, done + len(members)
            placed.append(members)
            done += len(members)
            continue
        own = points[members]
        near = _distances(own, nodes[node][0])
        owner = np.zeros(len(members), np.int64)
        centers = [nodes[node][0]]
        # Farthest-first: the next centre is the point that the net covers worst.
        while near.max() > radius / SHRINK and len(centers) < max(2, math.ceil(len(members) / leaf)):
            center = own[int(near.argmax())]
            distance = _distances(own, center)
            closer = distance < near
            owner[closer], near[closer] = len(centers), distance[closer]
            centers.append(center)
        nodes[node][2] = len(nodes)
        for i, center in enumerate(centers):
            part = members[owner == i]
            if len(part):
                add(part, center)
        nodes[node][3] = len(nodes) - nodes[node][2]
        if nodes[node][3] == 1:  # nothing to separate: a leaf after all
            nodes.pop()
            queue.pop()
            nodes[node][2:6] = 0, 0, done, done + len(members)
            placed.append(members)
            done += len(members)
    along = np.concatenate(placed) if placed else np.zeros(0, np.int64)
    width = points.shape[1] if points.ndim == 2 else 0
    return Tree(
        ids[along], points[along], np.array([n[0] for n in nodes]).reshape(len(nodes), width),
        np.array([n[1] for n in nodes]), *(np.array([n[i] for n in nodes], np.int64) for i in range(2, 6)),
    )


def _leaf_range(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Points below every node, as a range; children come after their parents."""
    low, high = tree.low.copy(), tree.high.copy()
    for i in range(len(low) - 1, -1, -1):
        if tree.count[i]:
            children = slice(tree.first[i], tree.first[i] + tree.count[i])
            low[i], high[i] = low[children].min(), high[children].max()
    return low, high


class Search:
    """Best ``k`` (score, id) of every query of a tree, over data trees met so far."""

    def __init__(self, queries: Tree, k: int, floor: np.ndarray | None = None):
        self.queries, self.k = queries, k
        n = len(queries.ids)
        self.scores = np.full((n, k), _NONE, np.int64)
        self.found = np.zeros((n, k), np.int64)
        # k-th scores known from elsewhere; only what reaches them matters.
        self.floor = np.full(n, _NONE, np.int64) if floor is None else floor
        self.low, self.high = _leaf_range(queries) if n else (None, None)
        self.pairs = 0

    def worst(self, node: int) -> int:
        """The least k-th score among the queries below a node."""
        own = slice(self.low[node], self.high[node])
        return int(np.maximum(self.scores[own, -1], self.floor[own]).min())

    def meet(self, data: Tree) -> None:
        q, norms = self.queries, np.sqrt((data.center**2).sum(axis=1))
        if not len(q.ids) or not len(data.ids):
            return
        q_norms = np.sqrt((q.center**2).sum(axis=1))

        def bounds(a: int, nodes: np.ndarray) -> np.ndarray:
            exact = data.center[nodes] @ q.center[a]
            loose = q.radius[a] * norms[nodes] + data.radius[nodes] * (q_norms[a] + q.radius[a])
            # Above any rounding, also where large terms cancel out.
            return (exact + loose) * (1 + 1e-12) + 1e-12 * norms[nodes] * q_norms[a] + 1e-3

        stack = [(0, np.zeros(1, np.int64))]
        while stack:
            a, nodes = stack.pop()
            # Open the data side of every pair first, then the query side.
            bound, leaves = bounds(a, nodes), []
            while True:
                keep = bound >= self.worst(a)
                nodes, bound = nodes[keep], bound[keep]
                inner = data.count[nodes] > 0
                leaves.append(nodes[~inner])
                if not inner.any():
                    break
                count = data.count[nodes[inner]]
                start = np.repeat(data.first[nodes[inner]] - np.r_[0, np.cumsum(count)[:-1]], count)
                nodes = start + np.arange(len(start))
                bound = bounds(a, nodes)
            nodes = np.concatenate(leaves)
            if not len(nodes):
                continue
            if q.count[a]:
                for child in range(q.first[a], q.first[a] + q.count[a]):
                    stack.append((child, nodes))
                continue
            # A query leaf against data leaves, the most promising ones first, then ever more at once.
            bound = bounds(a, nodes)
            order = np.argsort(-bound, kind="stable")
            nodes, bound, size = nodes[order], bound[order], 1
            while len(nodes):
                keep = int(np.searchsorted(-bound, -self.worst(a), side="right"))
                nodes, bound = nodes[:keep], bound[:keep]
                if keep:
                    self._score(a, data, nodes[:size])
                nodes, bound, size = nodes[size:], bound[size:], min(2 * size, LEAVES_AT_ONCE)

    def _score(self, a: int, data: Tree, nodes: np.ndarray) -> None:
        own = slice(self.low[a], self.high[a])
        there = np.concatenate([np.arange(data.low[n], data.high[n]) for n in nodes])
        ids, points = data.ids[there], data.points[there]
        product = self.queries.points[own] @ points.T
        if max(product.max(initial=0), -product.min(initial=0)) >= 2**52:  # beyond exact floating point
            product = self.queries.points[own].astype(np.int64) @ points.astype(np.int64).T
        score = product.astype(np.int64)
        self.pairs += score.size
        score[self.queries.ids[own, None] == ids[None, :]] = _NONE
        worth = (score >= np.maximum(self.scores[own, -1], self.floor[own])[:, None]) & (score > _NONE)
        for i in np.flatnonzero(worth.any(axis=1)):
            row, some = self.low[a] + i, np.flatnonzero(worth[i])
            s = np.r_[self.scores[row], score[i, some]]
            f = np.r_[self.found[row], ids[some]]
            best = np.lexsort((f, -s))[:self.k]
            self.scores[row], self.found[row] = s[best], f[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score) of what was found."""
        there = self.scores > _NONE
        return np.repeat(self.queries.ids, self.k)[there.ravel()], self.found[there], self.scores[there]


def whole_components(embedding, scale: int = SCALE):
    """floor(scale * x) of every component, or NULL where the vector takes no part."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    limit = F.sqrt(F.lit(float(LARGEST_SCORE)) / F.greatest(F.size(embedding), F.lit(1))) / scale
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < limit))
    return F.when(embedding.isNotNull() & sound, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
    out[row, place] = flat
    return out


def pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first points of the sample: the top level of the cover."""
    if not len(sample):
        return sample
    chosen, near = [0], _distances(sample, sample[0])
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1]]))
    return sample[chosen]


def _assign(centers: np.ndarray):
    """Task: (id, is_query, vector) to the cell of the nearest pivot and the distance."""
    square = (centers**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column(2), centers.shape[1])
            cell = (square[None, :] - 2 * points @ centers.T).argmin(axis=1)
            far = np.sqrt(((points - centers[cell]) ** 2).sum(axis=1))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(cell.astype(np.int64)), pa.array(far)],
                ["id", "is_query", "vector", "cell", "far"],
            )

    return run


def _plant(width: int, leaf: int):
    """Group (cell, part): its vectors as one pickled tree."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        points = np.zeros((len(rows), width))
        for i, v in enumerate(rows["vector"]):
            points[i, :len(v)] = v
        tree = build(rows["id"].to_numpy(np.int64), points, leaf)
        small = np.abs(tree.points).max(initial=0) < 1 << 31
        tree.points = tree.points.astype(np.int32 if small else np.int64)  # whole numbers
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "n": [len(rows)], "tree": [pickle.dumps(tree)]})

    return run


NEEDED = pa.list_(pa.struct([("shelf", pa.int32()), ("cells", pa.list_(pa.int64()))]))


def _load(blob: bytes) -> Tree:
    tree = pickle.loads(blob)
    tree.points = tree.points.astype(np.float64)
    return tree


def _shelved(trees: pa.StructArray) -> list[tuple[int, int, Tree]]:
    """The (cell, part, tree) of a shelf."""
    return [(t["cell"], t["part"], _load(t["data"])) for t in trees.to_pylist()]


def _scorer(k: int):
    """Query trees past a shelf, each with the cells that it needs there, to the best of each query."""

    def score(shelf: list[tuple[int, int, Tree]], asked: pa.StructArray) -> pa.RecordBatch:
        found = [(np.zeros(0, np.int64),) * 3]
        for row in asked:
            home, cells = (row["home_cell"].as_py(), row["home_part"].as_py()), set(row["cells"].as_py())
            search = Search(_load(row["queries"].as_py()), k, np.frombuffer(row["floors"].as_py(), np.int64))
            for cell, part, data in shelf:
                if cell in cells and (cell, part) != home:
                    search.meet(data)
            found.append(search.rows())
        return pa.record_batch(
            [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"]
        )

    return score


def _first(k: int, centers: np.ndarray, radii: np.ndarray, shelves: tuple[np.ndarray, np.ndarray]):
    """Task: rows (cell, part, queries, data) of the same cell and part to the best
    there, the k-th scores, and the cells that the bound leaves, by shelf (``shelves``:
    the first and last one of every cell)."""
    norms = np.sqrt((centers**2).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, part, blob, data in zip(*(batch.column(i) for i in range(4)), strict=True):
                search = Search(_load(blob.as_py()), k)
                search.meet(_load(data.as_py()))
                tree = search.queries
                root, r = tree.center[0], tree.radius[0]
                bound = centers @ root + r * norms + radii * (math.sqrt(float(root @ root)) + r)
                left = np.flatnonzero((bound * (1 + 1e-12) + 1e-3 >= search.worst(0)) & (radii >= 0))
                there: dict[int, list[int]] = {}
                for c in left.tolist():
                    for shelf in range(int(shelves[0][c]), int(shelves[1][c]) + 1):
                        there.setdefault(shelf, []).append(c)
                needed = [{"shelf": shelf, "cells": cells} for shelf, cells in there.items()]
                best = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in search.rows()]
                yield pa.record_batch(
                    [
                        pa.array([cell.as_py()]), pa.array([part.as_py()]), pa.array([blob.as_py()]),
                        pa.array([search.scores[:, -1].tobytes()]), pa.array([needed], NEEDED), *best,
                    ],
                    ["cell", "part", "queries", "floors", "needed", "query_id", "vec_id", "score"],
                )

    return run


def top_k(
    vectors: DataFrame, every: int = 50, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
    part: int = PART, leaf: int = LEAF, most_pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of each query.

    Queries are the rows whose id is divisible by ``every``; candidates all rows
    but those with the query's own id; ties go to the smaller id. Components are
    floor(256 x). NULL ids take no part, nor vectors that are NULL or hold a
    NULL or a non-finite number, nor ones so large that an inner product might not
    be a 64-bit number (with 64 components, one of 1,048,576 and more). Vectors of
    unequal length are filled up with zeros. An id on several rows is a candidate
    once per row, and asked once, with its least vector. An empty table gives an
    empty table.
    """
    rows = pick(vectors, id=id_col, vector=vector_col)
    sound = cut_lineage(
        rows.select(
            F.col("id").cast("long").alias("id"), (F.col("id") % every == 0).alias("is_query"),
            whole_components(F.col("vector")).alias("vector"),
        ).where("id IS NOT NULL AND vector IS NOT NULL")
    )
    spark = vectors.sparkSession
    shape = sound.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    count, width = shape["n"], shape["width"] or 1
    # Every partition sends its candidates for the sample to the driver: their hashes first, the vectors of those chosen then.
    spread = F.xxhash64("id")
    last = [r[0] for r in sound.select(spread.alias("h")).orderBy("h").limit(SAMPLE).collect()]
    chosen = sound.where(spread <= last[-1]) if last else sound
    some = chosen.orderBy(spread, "id").limit(SAMPLE).select("id", "vector").collect()
    sample = np.zeros((len(some), width))
    for i, r in enumerate(sorted(some)):
        sample[i, :len(r["vector"])] = r["vector"]
    centers = pivots(sample, max(1, min(most_pivots, math.ceil(count / part))))
    if not len(centers):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    held = sound.mapInArrow(
        _assign(centers), "id long, is_query boolean, vector array<long>, cell long, far double"
    )
    # One row per pivot; nothing here grows with the table.
    cells = {r["cell"]: r for r in held.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    radii = np.array([cells[c]["far"] if c in cells else -1.0 for c in range(len(centers))])
    cut = np.array([max(1, math.ceil(cells[c]["n"] / part)) if c in cells else 1 for c in range(len(centers))])
    # Trees are numbered cell by cell; as many neighbours stand on one shelf.
    ends, cores = np.cumsum(cut), spark.sparkContext.defaultParallelism
    on_shelf = max(1, min(SHELF_VALUES // (part * width), math.ceil(ends[-1] / (SHELVES_PER_CORE * cores))))
    shelves = (ends - cut) // on_shelf, (ends - 1) // on_shelf

    def of_cell(values: np.ndarray):
        return F.element_at(F.array(*[F.lit(int(v)) for v in values]), (F.col("cell") + 1).cast("int"))

    parts = of_cell(cut)
    dealt = held.withColumn("part", F.pmod(F.xxhash64("id"), parts))
    trees = "cell long, part long, n long, tree binary"
    data = cut_lineage(dealt.groupBy("cell", "part").applyInPandas(_plant(width, leaf), trees))
    asked = cut_lineage(
        dealt.where("is_query").groupBy("id").agg(F.min(F.struct("vector", *[c for c in dealt.columns if c != "vector"])).alias("r"))
        .select("r.*").groupBy("cell", "part")
        .applyInPandas(_plant(width, min(leaf, QUERY_LEAF)), trees)
    ).select("cell", "part", F.col("tree").alias("queries"))
    planted = data.select("cell", "part", F.col("tree").alias("data"))
    first = cut_lineage(asked.join(planted, ["cell", "part"]).mapInArrow(
        _first(k, centers, radii, shelves),
        "cell long, part long, queries binary, floors binary, needed array<struct<shelf: int, cells: array<bigint>>>, "
        "query_id array<long>, vec_id array<long>, score array<long>",
    ))
    found = first.select(F.explode(F.arrays_zip("query_id", "vec_id", "score")).alias("r")).select("r.*")
    wanted = first.select(
        F.col("cell").alias("home_cell"), F.col("part").alias("home_part"), "queries", "floors",
        F.explode("needed").alias("s"),
    ).select("s.shelf", "home_cell", "home_part", "queries", "floors", "s.cells")
    stand = F.floor((of_cell(ends - cut) + F.col("part")) / on_shelf).cast("int").alias("shelf")
    rest = meet(
        planted.select(stand, "cell", "part", "data"), wanted, ["shelf"], _shelved, _scorer(k),
        "query_id long, vec_id long, score long",
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.unionByName(rest).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
