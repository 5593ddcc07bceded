"""Near copies by shingle similarity, found through SimHash shards and checked exactly.

Two documents are near copies where the sets of their five-word shingles have a
Jaccard similarity of 0.8 or more. A single fingerprint within a few bits finds
few of those, so each distinct set gets ``WORDS`` independent 64-bit SimHash
fingerprints; sets that agree on any 16-bit block of any of them meet in a
shard, whose BK-tree reports fingerprints within ``RADIUS``. The links found
give candidate clusters, inside which sets are compared by their shingles, so
nothing is linked on fingerprints alone.

A shard above its size is cut into parts, and each pair of parts becomes a shard.
A large cluster is first compared with a few of its sets (leaders). The sets at
0.8 and more to one leader are linked by that, and need not be compared with
each other; only the rest is compared with the whole cluster, part by part while
the cluster streams past. Every pair that could join two groups is still seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from webstrata.llm.components import components
from webstrata.llm.shared import LOCATION, join_lines, line_maps, located
from webstrata.llm.simhash import BUFFER_ROWS, SEED, SHARD_ROWS, BKForest, join_labels
from webstrata.operators.meeting import meet
from webstrata.session import cut_lineage, scratch

SHINGLE_WORDS = 5
#: Least similarity, as a fraction of whole numbers.
LEAST = (4, 5)
#: Independent fingerprints, and bits of the blocks that they are cut into.
WORDS, BLOCK = 16, 16
#: Fingerprints searched before groups get a name.
FIRST_WORDS = 4
#: Bits that a fingerprint, and it with the next one, may differ by.
RADIUS, RADIUS_TWO = 16, 30
#: Shard sizes are estimated on one node of so many.
SIZE_SAMPLE = 16
#: Sets of one cluster above which it is cut into parts; bytes of sets held by a task.
CLUSTER_ROWS, HELD_BYTES = 2048, 64 << 20
#: Sets of a cluster that all its sets are compared with first.
LEADERS = 8
DIGEST = 16
_STEP = np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, words_per_shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, no words are none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = len(words) - words_per_shingle + 1
    if n < 1:
        found = [b" ".join(words)]
    else:
        found = map(b" ".join, zip(*(words[i:] for i in range(words_per_shingle)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, max(n, 1)))


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` majority votes of 64 bits, each over its own rehash of the shingles."""
    votes = np.zeros(WORDS * 64, np.int64)
    for low in range(0, len(hashes), 255):
        h = hashes[low:low + 255, None] + _STEP
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")


@pandas_udf(BinaryType())
def _marks(texts: pd.Series) -> pd.Series:
    """Digest of the shingle set, then its fingerprints."""
    sets = (shingles(t) for t in texts)
    return pd.Series([xxhash.xxh3_128_digest(s.tobytes()) + fingerprints(s).tobytes() for s in sets])


@pandas_udf(BinaryType())
def _sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).tobytes() for t in texts])


def _blocks(first: int, end: int):
    """Task: rows (node, mark) to (shard, node, word, next), one per block of fingerprints ``first`` .. ``end``."""
    per_word = 64 // BLOCK
    count = (end - first) * per_word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column(0).to_numpy(zero_copy_only=False)
            marks = np.frombuffer(b"".join(m[DIGEST:] for m in batch.column(1).to_pylist()), "<u8").reshape(-1, WORDS)
            own, after = marks[:, first:end], np.roll(marks, -1, axis=1)[:, first:end]
            shift = np.arange(per_word, dtype=np.uint64) * np.uint64(BLOCK)
            block = ((own[:, :, None] >> shift) & np.uint64((1 << BLOCK) - 1)).reshape(-1, count).astype(np.int64)
            shard = block + (np.arange(count) + first * per_word << BLOCK)
            words = (np.repeat(w, per_word, axis=1).ravel().view(np.int64) for w in (own, after))
            columns = [shard.ravel(), np.repeat(node, count), *words]
            yield pa.record_batch([pa.array(c) for c in columns], ["shard", "node", "word", "next"])

    return run


def _shards(marks: DataFrame, first: int, end: int, shard_rows: int) -> DataFrame:
    """Rows (shard, node, word, next) of fingerprints ``first`` .. ``end``; a large shard becomes one shard per pair of its parts.

    Sizes are estimated on one node of ``SIZE_SAMPLE``. They only decide into how
    many parts a shard is cut: every two nodes of a shard meet, whatever it is.
    """
    schema, blocks = "shard long, node long, word long, next long", _blocks(first, end)
    few = marks.where(F.pmod(F.xxhash64("node"), F.lit(SIZE_SAMPLE)) == 0)
    counted = few.mapInArrow(blocks, schema).groupBy("shard").count()
    large = cut_lineage(
        counted.where(F.col("count") * SIZE_SAMPLE > shard_rows)
        .select("shard", F.ceil(F.col("count") * SIZE_SAMPLE / shard_rows).cast("long").alias("parts"))
    )
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    pairs = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("parts") - 1),
        lambda j: F.least(own, j) * F.col("parts") + F.greatest(own, j) + 1,
    )
    part = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
    # Shard (22 bits) and part in one number.
    return marks.mapInArrow(blocks, schema).join(large, "shard", "left").withColumn("part", F.explode(part)).select(
        (F.shiftleft("part", 22) + F.col("shard")).alias("shard"), "node", "word", "next"
    )


def _candidates(node: np.ndarray, shard: np.ndarray, word: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the nodes of each shard whose fingerprints are near."""
    labels = np.arange(len(node))
    for a, b in BKForest(word, shard).links(RADIUS):
        near = np.bitwise_count(word[a] ^ word[b]) + np.bitwise_count(after[a] ^ after[b]) <= RADIUS_TWO
        labels = join_labels(labels, a[near], b[near])
    linked = np.flatnonzero(labels != np.arange(len(node)))
    return node[linked], node[labels[linked]]


class Sets:
    """Sets of numbers, ready to be compared with others."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        joined = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(joined, kind="stable")
        # Owners of each distinct number, one after the other.
        self.owner = owner[order]
        self.names, self.start = np.unique(joined[order], return_index=True)
        self.end = np.r_[self.start[1:], len(joined)]

    def near(self, other: np.ndarray) -> np.ndarray:
        """Positions of the sets whose similarity to ``other`` is ``LEAST`` or more."""
        if not len(self.names):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.names, other), len(self.names) - 1)
        at = at[self.names[at] == other]
        count = self.end[at] - self.start[at]
        runs = np.repeat(self.start[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        shared = np.bincount(self.owner[runs], minlength=len(self.size))
        up, down = LEAST
        return np.flatnonzero(down * shared >= up * (self.size + len(other) - shared))


def similar(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (positions) of the sets whose similarity is ``LEAST`` or more.

    Sets near one leader are linked through it. All other sets are compared with
    everything, so a pair is left out only where both are near that leader.
    """
    # No set is empty here: texts without words are one node, in no cluster.
    held, labels = Sets(sets), np.arange(len(sets))
    star = np.zeros(0, np.int64)
    for leader in range(min(LEADERS, len(sets))):
        near = held.near(sets[leader])
        labels = join_labels(labels, np.full(len(near), leader), near)
        star = near if len(near) > len(star) else star
    for i in np.setdiff1d(np.arange(len(sets)), star):
        near = held.near(sets[i])
        labels = join_labels(labels, np.full(len(near), i), near)
    linked = np.flatnonzero(labels != np.arange(len(sets)))
    return linked, labels[linked]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links a-b between nodes, as a spanning forest towards the least node of each group."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    labels = join_labels(np.arange(len(names)), at[:len(a)], at[len(a):])
    linked = np.flatnonzero(labels != np.arange(len(names)))
    return names[linked], names[labels[linked]]


def _by_group(
    settle: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]], most_rows: int, most_bytes: int
):
    """Task: rows sorted by their first column to links, whole groups at a time.

    The links of all groups that a task holds at once are one spanning forest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def starts(table: pa.Table) -> np.ndarray:
            key = table.column(0).to_numpy()
            return np.r_[True, key[1:] != key[:-1]]

        def links(table: pa.Table) -> pa.RecordBatch:
            a, b = _forest(*settle(table, np.cumsum(starts(table))))
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= most_rows or sum(b.nbytes for b in held) >= most_bytes:
                table = pa.Table.from_batches(held)
                cut = int(np.flatnonzero(starts(table))[-1])
                if cut:
                    yield links(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _search(table: pa.Table, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    node, word, after = (table.column(c).to_numpy() for c in ("node", "word", "next"))
    return _candidates(node, shard, word.view(np.uint64), after.view(np.uint64))


def _compare(table: pa.Table, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    node, sets = table.column("node").to_numpy(), table.column("shingles").to_pylist()
    bounds = np.r_[np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]]), len(cluster)]
    out = [(np.zeros(0, np.int64),) * 2]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        a, b = similar([np.frombuffer(t, np.uint64) for t in sets[low:high]])
        out.append((node[low + a], node[low + b]))
    return tuple(np.concatenate(side) for side in zip(*out, strict=True))


def _hold(rows: pa.StructArray) -> tuple[np.ndarray, Sets]:
    sets = [np.frombuffer(s, np.uint64) for s in rows.field("shingles").to_pylist()]
    return rows.field("node").to_numpy(zero_copy_only=False), Sets(sets)


def _stream(held: tuple[np.ndarray, Sets], rows: pa.StructArray) -> pa.RecordBatch:
    nodes, sets = held
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for node, own in zip(rows.field("node").to_pylist(), rows.field("shingles").to_pylist(), strict=True):
        near = nodes[sets.near(np.frombuffer(own, np.uint64))]
        a.append(np.full(len(near), node))
        b.append(near)
    a, b = _forest(np.concatenate(a), np.concatenate(b))
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _near_held(held: tuple[np.ndarray, Sets], rows: pa.StructArray) -> pa.RecordBatch:
    """(label, node, near): the held sets that each passing set is near to."""
    nodes, sets = held
    near = [nodes[sets.near(np.frombuffer(s, np.uint64))].tolist() for s in rows.field("shingles").to_pylist()]
    return pa.record_batch([rows.field("of"), rows.field("node"), pa.array(near, pa.list_(pa.int64()))], ["label", "node", "near"])


def _large_links(sets: DataFrame, large: DataFrame, cluster_rows: int) -> DataFrame:
    """Links among the sets (label, node, shingles) of ``large`` clusters (label, parts)."""
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    of = F.col("label").alias("of")
    wide = sets.join(large, "label")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("node"), "node"))
    leaders = wide.withColumn("n", rank).where(F.col("n") <= LEADERS)
    met = cut_lineage(meet(
        leaders.select("label", every, "node", "shingles"), wide.select("label", own, of, "node", "shingles"),
        ["label", "part"], _hold, _near_held, "label long, node long, near array<long>",
    ))
    links = met.select(F.col("node").alias("a"), F.explode("near").alias("b"))
    # The leader with the most sets near it; only sets away from it are compared further.
    best = met.select("label", F.explode("near").alias("leader")).groupBy("label", "leader").count()
    best = best.groupBy("label").agg(F.max_by("leader", F.struct("count", "leader")).alias("leader"))
    away = cut_lineage(met.join(best, "label").where(~F.array_contains("near", F.col("leader"))).select("label", "node"))
    parts = cut_lineage(away.groupBy("label").agg(F.ceil(F.count("*") / cluster_rows).cast("int").alias("parts")))
    held = away.join(parts, "label").join(sets, ["label", "node"]).select("label", own, "node", "shingles")
    passing = sets.join(parts, "label").select("label", every, "node", "shingles")
    return links.unionByName(meet(held, passing, ["label", "part"], _hold, _stream, "a long, b long"))


def near_links(
    marks: DataFrame, texts_of: Callable[[DataFrame], DataFrame], shard_rows: int = SHARD_ROWS,
    cluster_rows: int = CLUSTER_ROWS,
) -> DataFrame:
    """(a, b): links that span each group of near copies among written ``marks``
    (node, mark; one per distinct set); ``texts_of`` adds ``text`` to rows with a ``node``."""
    def candidates(named: DataFrame, first: int, end: int) -> DataFrame:
        dealt = _shards(named, first, end, shard_rows).repartition("shard").sortWithinPartitions("shard", "node")
        return dealt.mapInArrow(_by_group(_search, BUFFER_ROWS, 1 << 30), "a long, b long")

    # The first fingerprints join most of a group. For the others a set goes by the
    # name of its group so far, so links within a group are not reported again.
    known = components(candidates(marks, 0, FIRST_WORDS))
    named = marks.join(known, "node", "left").select(F.coalesce("label", "node").alias("node"), "mark")
    more = candidates(named, FIRST_WORDS, WORDS)
    found = components(more.unionByName(known.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    clusters = cut_lineage(
        found.unionByName(found.select(F.col("label").alias("node"), "label").distinct())
    )
    large = cut_lineage(
        clusters.groupBy("label").count().where(F.col("count") > cluster_rows)
        .select("label", F.ceil(F.col("count") / cluster_rows).cast("int").alias("parts"))
    )
    sets = cut_lineage(
        texts_of(clusters).select("label", "node", _sets(F.col("text").cast("binary")).alias("shingles"))
    )
    small = sets.join(large, "label", "left_anti").repartition("label").sortWithinPartitions("label")
    links = small.select("label", "node", "shingles").mapInArrow(_by_group(_compare, 1 << 62, HELD_BYTES), "a long, b long")
    return links.unionByName(_large_links(sets, large, cluster_rows))


def keep_one(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS,
    cluster_rows: int = CLUSTER_ROWS,
) -> DataFrame:
    """The documents, with one row of each group of near copies: the least id's.

    Groups are the connected components of near copies. All columns stay. Texts
    without words are copies of each other. Of several rows with the least id
    the least by a hash of the row is kept, and so is a row of a group without ids.
    """
    names = documents.columns
    table, place_of = located(documents)
    with scratch(documents.sparkSession) as keep:
        plain = [F.col(f"`{f.name}`") for f in documents.schema if f.dataType.simpleString()[:3] != "map"]
        # The narrow table: where a row is, its shingle set and fingerprints, its order within a group.
        narrow = cut_lineage(
            table.select(
                *place_of, _marks(F.col(f"`{text_col}`").cast("binary")).alias("mark"),
                F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(2**63 - 1)).alias("id"), F.xxhash64(*plain).alias("tie"),
                F.monotonically_increasing_id().alias("node"),
            ).withColumn("digest", F.substring("mark", 1, DIGEST))
        )
        nodes = cut_lineage(narrow.groupBy("digest").agg(
            F.min(F.struct("id", "tie", "node")).alias("place"), F.first("mark").alias("mark")
        ).withColumn("node", F.col("place.node")))
        # Texts without words are one node and near nothing else.
        empty = F.unhex(F.lit(xxhash.xxh3_128_hexdigest(b"")))
        marks = nodes.where(F.col("digest") != empty).select("node", "mark")
        spots = narrow.select(*LOCATION, "node")
        text = F.col(f"`{text_col}`").alias("text")

        def texts_of(rows: DataFrame) -> DataFrame:
            """Texts are read again where they are needed, by the place of their row."""
            wanted = cut_lineage(rows.join(spots, "node"))
            # Texts that are not wanted are left out where they are read, before any shuffle.
            texts = join_lines(table, place_of, cut_lineage(line_maps(wanted)), "left_semi").select(*LOCATION, text)
            return texts.join(wanted, list(LOCATION))

        linked = components(near_links(marks, texts_of, shard_rows, cluster_rows))
        groups = cut_lineage(nodes.select("digest", "node", "place").join(linked, "node", "left").select(
            "digest", "node", "place", F.coalesce("label", "node").alias("label")
        ))
        heads = groups.groupBy("label").agg(F.min_by("node", "place").alias("head"))
        gone = keep(line_maps(
            narrow.select("digest", "node", *LOCATION)
            .join(groups.join(heads, "label").select("digest", "head"), "digest").where("node <> head")
        ))
    kept = join_lines(table, place_of, gone, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in names])
