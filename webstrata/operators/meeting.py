"""Two tables that meet by key, one side held, the other streamed past it.

A co-group holds both sides of a key at once. Here only one side is held, which
the caller keeps small by cutting it into parts; the rows of the other side are
scored batch by batch as they come, however many share the key. Both sides are
shuffled once by the key and sorted with the held rows first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TopK:
    """Best k (score desc, id asc) per row of a query batch over any number of score chunks."""

    def __init__(self, queries: int, k: int, edge: np.ndarray | None = None):
        """``edge``: scores known to be needed; lower ones do not count."""
        self.k = k
        self.edge = np.full(queries, -np.inf) if edge is None else edge
        self.q = np.empty(0, dtype=np.int64)
        self.ids = np.empty(0, dtype=np.int64)
        self.scores = np.empty(0)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` is queries × ids; -inf marks a pair that does not count."""
        k, edge = self.k, self.edge
        if scores.shape[1] > k:
            # Ties with the k-th value stay in, the id decides below.
            edge = np.maximum(edge, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
        self.merge(row, ids[col], scores[row, col])

    def merge(self, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Single scores: of query ``row[i]`` and ``ids[i]``."""
        k = self.k
        q = np.concatenate([self.q, row])
        i = np.concatenate([self.ids, ids])
        s = np.concatenate([self.scores, scores])
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        kept = place < k
        self.q, self.ids, self.scores = q[kept], i[kept], s[kept]
        last = place[kept] == k - 1
        self.edge[self.q[last]] = self.scores[last]


def _codes(column: pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False)
    encoded = column.dictionary_encode(null_encoding="encode")
    return encoded.indices.to_numpy(zero_copy_only=False)


def _changes(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Positions where a new run of equal keys and kind begins, 0 included."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in columns:
        codes = _codes(batch.column(name))
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def meet(
    held: DataFrame, streamed: DataFrame, keys: list[str],
    prepare: Callable[[pa.StructArray], object], score: Callable[[object, pa.StructArray], pa.RecordBatch],
    schema: str,
) -> DataFrame:
    """``score(prepare(held rows), batch of streamed rows)`` for every key.

    Both functions get the columns beside the keys as one struct array. Streamed
    rows without held rows of their key are dropped.
    """
    def side(df: DataFrame, kind: int) -> DataFrame:
        own = F.struct(*[F.col(c) for c in df.columns if c not in keys])
        return df.select(*keys, F.lit(kind).alias("__kind"), own.alias("__held" if kind == 0 else "__streamed"))

    both = side(held, 0).unionByName(side(streamed, 1), allowMissingColumns=True)
    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "__kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _changes(batch, [*keys, "__kind"])
            for low, high in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                own = tuple(batch.column(c)[int(low)].as_py() for c in keys)
                if own != key:
                    key, parts, ready = own, [], None
                if batch.column("__kind")[int(low)].as_py() == 0:
                    parts.append(batch.column("__held").slice(low, high - low))
                elif parts:
                    ready = ready or prepare(pa.concat_arrays(parts))
                    yield score(ready, batch.column("__streamed").slice(low, high - low))

    return dealt.mapInArrow(run, schema)
