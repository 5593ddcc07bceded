"""SimHash near-duplicates, linked by searching BK-trees of fingerprint shards.

Fingerprints are 64-bit majority votes over hashed word shingles. Two of them
within ``radius`` bits agree wholly on at least one of ``radius + 1`` blocks, so
each distinct fingerprint goes to one shard per block. Every shard gets a
BK-tree: the children of a node are keyed by their Hamming distance to it, and a
search from a fingerprint at distance d only follows the edges d-radius to
d+radius. The tree of a shard stands beside all its queries in the task that
holds the shard. A shard above ``shard_rows`` fingerprints is cut into parts,
and each pair of parts becomes a shard of its own, so no task grows with the
largest group and no pair is lost. Tasks report a spanning forest of the links
they find, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from webstrata.llm.components import components
from webstrata.llm.shared import fresh, pick
from webstrata.session import cut_lineage

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Fingerprints of one shard above which it is cut into parts.
SHARD_ROWS = 1024
#: Query-node pairs that one search step may hold.
FRONTIER = 4_000_000
#: Rows that a task reads before it searches the shards that are complete.
BUFFER_ROWS = 500_000


def fingerprint(text: bytes | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one UTF-8 text as an unsigned number; 0 without words."""
    words = (text or b"").lower().split()
    n = len(words) - words_per_shingle + 1
    if not words:
        return 0
    if n < 1:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle)), strict=False))
    digest, count = xxhash.xxh64_intdigest, max(n, 1)
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, count)
    votes = np.zeros(64, np.int64)
    for low in range(0, count, 1 << 15):
        bits = np.unpackbits(hashes[low:low + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > count, bitorder="little").view("<u8")[0])


@pandas_udf(LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    values = np.array([fingerprint(t) for t in texts], np.uint64)
    return pd.Series(values.view(np.int64))


def fingerprint_column(text: Column) -> Column:
    """The fingerprint's 64 bits as a long. The whole text counts."""
    return _fingerprint(text.cast("binary"))


def fingerprint_hex(code: Column) -> Column:
    return F.lpad(F.lower(F.hex(code)), 16, "0")


class BKForest:
    """BK-trees over the shards of a batch, as flat arrays.

    ``codes`` are unsigned and differ within a shard; ``shard`` is sorted. All
    trees grow one level per pass: whoever is not a node yet moves along the
    edge of its distance, and the first to come along an edge becomes its node.
    """

    def __init__(self, codes: np.ndarray, shard: np.ndarray):
        self.codes = codes
        n = len(codes)
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, np.int64)
        self.sizes = np.diff(np.r_[first, n])
        self.root = np.repeat(first, self.sizes)
        at, keys, nodes = self.root.copy(), [], []
        waiting = np.flatnonzero(np.arange(n) != self.root)
        while waiting.size:
            edge = at[waiting] * 65 + np.bitwise_count(codes[waiting] ^ codes[at[waiting]])
            found, where, back = np.unique(edge, return_index=True, return_inverse=True)
            child = waiting[where]
            keys.append(found)
            nodes.append(child)
            at[waiting] = child[back]
            waiting = waiting[waiting != child[back]]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.edge = keys[order]
        self.child = np.concatenate(nodes)[order] if nodes else np.zeros(0, np.int64)

    def links(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions within ``radius``, each once, in bounded pieces."""
        reach = np.cumsum(np.repeat(self.sizes, self.sizes))
        start = 0
        while start < len(self.codes):
            base = reach[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(reach, base + FRONTIER, "right")))
            query = np.arange(start, stop)
            node = self.root[query]
            while query.size:
                distance = np.bitwise_count(self.codes[query] ^ self.codes[node]).astype(np.int64)
                hit = (distance <= radius) & (node > query)
                if hit.any():
                    yield query[hit], node[hit]
                low = np.searchsorted(self.edge, node * 65 + np.maximum(distance - radius, 0))
                high = np.searchsorted(self.edge, node * 65 + np.minimum(distance + radius, 64), "right")
                count = high - low
                query = np.repeat(query, count)
                skip = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]] if len(count) else low, count)
                node = self.child[np.arange(len(query)) + skip]
            start = stop


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least position of a group) after the links a-b are added."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            shorter = labels[labels]
            if (shorter == labels).all():
                break
            labels = shorter


def _search(codes: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    forest = BKForest(codes, shard)
    labels = np.arange(len(codes))
    for a, b in forest.links(radius):
        labels = join_labels(labels, a, b)
    linked = np.flatnonzero(labels != np.arange(len(codes)))
    return codes[linked], codes[labels[linked]]


def _searcher(radius: int):
    """Task: rows (shard, part, code) sorted by shard and part to linked codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def settle(rows: np.ndarray) -> pa.RecordBatch:
            new = np.r_[False, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
            a, b = _search(rows[:, 2].copy().view(np.uint64), np.cumsum(new), radius)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1))
            if sum(map(len, held)) >= BUFFER_ROWS:
                rows = np.concatenate(held)
                ends = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
                cut = int(ends[-1]) if len(ends) else 0
                if cut:
                    yield settle(rows[:cut])
                held = [rows[cut:]]
        if held:
            yield settle(np.concatenate(held))

    return run


def _blocks(code: Column, bits: int, count: int) -> list[tuple[Column, Column]]:
    """(block, all other bits) for each of ``count`` blocks of a ``bits``-bit number."""
    out, low = [], 0
    for i in range(count):
        width = bits // count + (i < bits % count)
        block = F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << width) - 1))
        above = F.lit(0).cast("long") if low + width == bits else F.shiftleft(
            F.shiftrightunsigned(code, low + width), low)
        out.append((block, above.bitwiseOR(code.bitwiseAND(F.lit((1 << low) - 1)))))
        low += width
    return out


def shards(codes: DataFrame, radius: int = RADIUS, levels: int = 1, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (shard, part, code): all codes within ``radius`` share some shard and part.

    A second level applies the same argument to the bits outside the shared
    block, which makes shards smaller by their square root of copies.
    """
    keys, count, code = [], radius + 1, F.col("code")
    for i, (block, rest) in enumerate(_blocks(code, 64, count)):
        bits = 64 - (64 // count + (i < 64 % count))
        if levels == 1:
            keys.append(block + (i << 58))
            continue
        for j, (inner, _) in enumerate(_blocks(rest, bits, count)):
            keys.append(F.shiftleft(block, 24) + inner + ((i * count + j) << 56))
    keyed = codes.select(F.explode(F.array(*keys)).alias("shard"), "code")
    large = (
        keyed.groupBy("shard").count().where(F.col("count") > shard_rows)
        .select("shard", F.ceil(F.col("count") / shard_rows).cast("long").alias("parts"))
    )
    own = F.pmod(F.xxhash64("code"), F.col("parts"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        lambda j: F.least(own, j) * F.col("parts") + F.greatest(own, j),
    )
    part = F.when(F.col("parts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(pairs)
    return keyed.join(large, "shard", "left").select("shard", F.explode(part).alias("part"), "code")


def near_groups(codes: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(code, label)`` of every distinct code; label: least code of its group.

    ``codes`` is a table of one long column ``code``, read more than once, so it
    is best a written one; NULL codes are left out. Works on any number of rows:
    two levels of blocks are taken where one would leave shards above a part
    each (the result is the same).
    """
    distinct = cut_lineage(codes.where("code IS NOT NULL").distinct())
    many = distinct.count()
    levels = 1 if many / 2 ** (64 // (radius + 1)) <= shard_rows else 2
    dealt = shards(distinct, radius, levels, shard_rows).repartition("shard", "part")
    links = dealt.sortWithinPartitions("shard", "part").mapInArrow(_searcher(radius), "a long, b long")
    found = components(links)
    return distinct.join(found, distinct["code"] == found["node"], "left").select(
        "code", F.coalesce("label", "code").alias("label")
    )


def near_duplicates(
    documents: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per row of ``documents``: id, fingerprint (hex) and group.

    ``component_id`` is the least id of the group, the row itself included.
    NULL, empty and blank texts have the fingerprint zero and link like any
    other. Repeated ids and rows stay; a NULL id stays NULL and names a group
    only if all its ids are NULL. An empty table gives an empty table, and
    further columns of the input play no part.
    """
    marked = cut_lineage(
        pick(documents, id=id_col, text=text_col).select("id", fingerprint_column(F.col("text")).alias("code"))
    )
    least = marked.groupBy("code").agg(F.min("id").alias("least"))
    groups = near_groups(marked.select("code"), radius, shard_rows).join(least, "code")
    heads = groups.groupBy("label").agg(F.min("least").alias("component"))
    named = groups.join(heads, "label").select("code", "component")
    return marked.join(named, "code").select(
        F.col("id").alias(id_col), fingerprint_hex(F.col("code")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def keep_one(
    documents: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents, with one row of each near-duplicate group: the least id's.

    All columns stay. Of several rows with that id (repeated rows) one is kept,
    the least by a hash of the row; a group without ids keeps one row as well.
    """
    names = documents.columns
    code, tie, row = fresh("code"), fresh("tie"), fresh("row")
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])))
    marked = cut_lineage(
        documents.withColumn(code, fingerprint_column(F.col(f"`{text_col}`"))).withColumn(tie, whole)
        .withColumn(row, F.monotonically_increasing_id())
    )
    narrow = marked.select(
        F.col(code).alias("code"), F.col(row).alias("row"),
        F.struct(F.coalesce(F.col(f"`{id_col}`"), F.lit(2**63 - 1)), F.col(tie), F.col(row)).alias("place"),
    )
    groups = cut_lineage(near_groups(narrow.select("code"), radius))
    least = narrow.groupBy("code").agg(F.min_by("row", "place").alias("row"), F.min("place").alias("place"))
    heads = groups.join(least, "code").groupBy("label").agg(F.min_by("row", "place").alias("head"))
    gone = (
        narrow.select("code", "row").join(groups.join(heads, "label").select("code", "head"), "code")
        .where("row <> head").select(F.col("row").alias(row))
    )
    return marked.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in names])
