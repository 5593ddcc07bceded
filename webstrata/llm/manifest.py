"""Merkle dataset manifest with multiproofs per leaf partition.

A tree stands over the leaves of every language, and one more over the languages'
subroots. Leaves get their place from a range partitioning by language and order
(a hot language spans many slices) and are dealt into leaf partitions of ``PART``
neighbouring leaves. Interior nodes are built in rounds of ``HEIGHT`` levels and
stored beside the leaves.

Proofs are not fetched leaf by leaf. A leaf partition works out the smallest set
of nodes that all its proofs together lack (for neighbouring leaves at most two a
level), one join fetches that set, and the partition derives the interiors that
its leaves share and expands the proof of each leaf from them.

Digests are stored as 32 bytes; hashes are taken over their lowercase hex text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm.shared import crc_mod, pick
from webstrata.session import cut_lineage

#: Levels that one round of building climbs; a block has two to this power leaves.
HEIGHT = 12
#: Leaves of one leaf partition.
PART = 8192
#: Tamper check: leaves whose id's crc32 this number divides are altered.
TAMPER = 7

_NODES = "tree long, level int, at long, digest binary"


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """sha256 of the values, each as its length in UTF-8, ``:`` and itself, ``-`` if NULL."""
    return F.sha2(F.concat(*[_part(v) for v in values]).cast("binary"), 256)


def parent_digest(children: Iterable[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def level_sizes(leaves: int) -> list[int]:
    """Nodes of every level, from the leaves to the root."""
    sizes = [leaves]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // 2))
    return sizes


def missing_nodes(held: Iterable[int], leaves: int) -> list[tuple[int, int]]:
    """(level, index) of the nodes that proofs of the ``held`` leaves need and cannot derive."""
    known, missing = sorted(set(held)), []
    for level, size in enumerate(level_sizes(leaves)[:-1]):
        have = set(known)
        missing += [(level, i ^ 1) for i in known if i ^ 1 < size and i ^ 1 not in have]
        known = sorted({i >> 1 for i in known})
    return missing


def derive(held: dict[int, bytes], fetched: dict[tuple[int, int], bytes], leaves: int) -> list[dict[int, bytes]]:
    """Every node, by level, that follows from held leaves and fetched nodes."""
    levels = [dict(held)]
    for level, size in enumerate(level_sizes(leaves)[:-1]):
        here = levels[-1]
        here.update({i: d for (n, i), d in fetched.items() if n == level})
        levels.append({
            p: parent_digest(here[i] for i in (2 * p, 2 * p + 1) if i < size)
            for p in {i >> 1 for i in here if i ^ 1 in here or i ^ 1 >= size}
        })
    return levels


def expand(levels: list[dict[int, bytes]], leaf: int, leaves: int) -> list[tuple[int, bytes]]:
    """Proof of one leaf: (side, sibling) a level; side 0 none, 1 left, 2 right."""
    proof = []
    for level, size in enumerate(level_sizes(leaves)[:-1]):
        sibling = leaf ^ 1
        proof.append((1 if leaf % 2 else 2, levels[level][sibling]) if sibling < size else (0, b""))
        leaf >>= 1
    return proof


def fold(digest: bytes, proof: Iterable[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its proof lead to."""
    for side, sibling in proof:
        digest = parent_digest([digest] if side == 0 else [sibling, digest] if side == 1 else [digest, sibling])
    return digest


def _climb(height: int):
    """Interior nodes above one aligned block, up to ``height`` levels or the root."""

    def run(group: pa.Table) -> pa.Table:
        tree, level, size = (group.column(c)[0].as_py() for c in ("tree", "level", "size"))
        here = dict(zip(group.column("at").to_pylist(), group.column("digest").to_pylist(), strict=True))
        levels, indexes, digests = [], [], []
        for step in range(1, height + 1):
            if size == 1:
                break
            parents = sorted({i >> 1 for i in here})
            here = {p: parent_digest(here[i] for i in (2 * p, 2 * p + 1) if i in here) for p in parents}
            size = -(-size // 2)
            levels += [level + step] * len(here)
            indexes += here
            digests += here.values()
        return pa.table({
            "tree": pa.array([tree] * len(levels), pa.int64()), "level": pa.array(levels, pa.int32()),
            "at": pa.array(indexes, pa.int64()), "digest": pa.array(digests, pa.binary()),
        })

    return run


def build_nodes(leaves: DataFrame, sizes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """All nodes (tree, level, at, digest), leaves included.

    ``leaves`` has (tree, at, digest) with gapless positions per tree, ``sizes``
    one row (tree, leaves). A round reads the nodes of one level, so the rounds
    number log(largest tree) / ``height``.
    """
    largest = sizes.agg(F.max("leaves")).first()[0] or 0
    nodes = leaves.select("tree", F.lit(0).alias("level"), "at", "digest")
    rounds, level = [nodes], 0
    while (largest - 1) >> level > 0:
        width = F.ceil(F.col("leaves") / F.lit(1 << level)).cast("long")
        base = rounds[-1].where(F.col("level") == level).join(sizes, "tree").select(
            "tree", "level", "at", "digest", width.alias("size"), F.shiftright("at", height).alias("block")
        )
        grown = base.groupBy("tree", "block").applyInArrow(_climb(height), _NODES)
        rounds.append(cut_lineage(grown))
        level += height
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def positions(rows: DataFrame, tree: str, order: list[str], part_leaves: int = PART) -> DataFrame:
    """Adds at (place in its tree) and part (leaf partition).

    Rows are range-partitioned by tree, order and row number, so equal rows are
    spread too; only a count per (tree, slice) is shuffled besides.
    """
    keyed = rows.withColumn("row", F.monotonically_increasing_id())
    columns = [tree, *order, "row"]
    sliced = cut_lineage(
        keyed.repartitionByRange(*columns).sortWithinPartitions(*columns)
        .withColumn("slice", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id())
    )
    runs = sliced.groupBy(tree, "slice").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    before = Window.partitionBy(tree).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut_lineage(runs.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    named = runs.select(F.col(tree).alias("run_tree"), F.col("slice").alias("run_slice"), "first", "base")
    match = sliced[tree].eqNullSafe(F.col("run_tree")) & (sliced["slice"] == F.col("run_slice"))
    placed = sliced.join(named, match).withColumn("at", F.col("base") + F.col("line") - F.col("first"))
    return placed.withColumn("part", F.floor(F.col("at") / part_leaves)).drop(
        "run_tree", "run_slice", "slice", "first", "base", "line", "row"
    )


def _lacking(group: pa.Table) -> pa.Table:
    """The minimal union of node coordinates that one leaf partition has to fetch."""
    tree, part, leaves = (group.column(c)[0].as_py() for c in ("tree", "part", "leaves"))
    wanted = missing_nodes(group.column("at").to_pylist(), leaves)
    return pa.table({
        "tree": pa.array([tree] * len(wanted), pa.int64()), "part": pa.array([part] * len(wanted), pa.int64()),
        "level": pa.array([n for n, _ in wanted], pa.int32()), "at": pa.array([i for _, i in wanted], pa.int64()),
    })


def _prove(held: pa.Table, fetched: pa.Table) -> pa.Table:
    """Proof, root and folded root of every leaf of one leaf partition."""
    leaves = held.column("leaves")[0].as_py()
    at, digests = held.column("at").to_pylist(), held.column("digest").to_pylist()
    nodes = zip(*(fetched.column(c).to_pylist() for c in ("node_level", "node_at", "node_digest")), strict=True)
    levels = derive(dict(zip(at, digests, strict=True)), {(n, i): d for n, i, d in nodes}, leaves)
    root = levels[-1][0]
    proofs = [expand(levels, i, leaves) for i in at]
    folded = [fold(d, p) for d, p in zip(held.column("claimed").to_pylist(), proofs, strict=True)]
    return pa.table({
        "tree": held.column("tree"), "id": held.column("id"), "digest": held.column("digest"),
        "top": pa.array([root] * len(at), pa.binary()), "folded": pa.array(folded, pa.binary()),
        "sides": pa.array([bytes(s for s, _ in p) for p in proofs], pa.binary()),
        "siblings": pa.array([b"".join(d for _, d in p) for p in proofs], pa.binary()),
    })


def prove(leaves: DataFrame, nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(tree, id, digest, top, folded, sides, siblings) of every leaf.

    ``leaves`` has (tree, part, at, id, digest, claimed): the proof is of the
    digest, the folded root starts from the claimed one. ``sides`` has one byte a
    level: 0 no sibling, 1 on the left, 2 on the right.
    """
    sized = leaves.join(sizes, "tree").select("tree", "part", "at", "id", "digest", "claimed", "leaves")
    wanted = sized.select("tree", "part", "at", "leaves").groupBy("tree", "part").applyInArrow(
        _lacking, "tree long, part long, level int, at long"
    )
    fetched = cut_lineage(wanted).join(nodes, ["tree", "level", "at"]).select(
        *[F.col(c).alias(f"node_{c}") for c in ("tree", "part", "level", "at", "digest")]
    )
    return sized.groupBy("tree", "part").cogroup(fetched.groupBy("node_tree", "node_part")).applyInArrow(
        _prove, "tree long, id long, digest binary, top binary, folded binary, sides binary, siblings binary"
    )


@dataclass(frozen=True)
class Tree:
    """Leaves (tree, part, at, id, digest, claimed), all nodes (tree, level, at, digest), leaves per tree."""

    leaves: DataFrame
    nodes: DataFrame
    sizes: DataFrame

    def roots(self) -> DataFrame:
        """(tree, digest) of every tree."""
        first = self.nodes.where(F.col("at") == 0)
        return first.groupBy("tree").agg(F.max_by("digest", "level").alias("digest"))

    def proofs(self) -> DataFrame:
        return prove(self.leaves, self.nodes, self.sizes)


@dataclass(frozen=True)
class Manifest:
    """Tree per language, and the tree over the languages' subroots.

    ``languages`` has (lang, tree, leaves); a language's tree number is its leaf
    id in ``top``.
    """

    languages: DataFrame
    documents: Tree
    top: Tree


def build(leaves: DataFrame, height: int = HEIGHT, part_leaves: int = PART) -> Manifest:
    """Manifest of leaves (lang, id, digest, claimed), claimed being what a holder of the leaf presents.

    Leaves ascend by id (NULL first), equal ids by digest. Languages ascend
    bytewise, NULL first. An empty table has no tree.
    """
    counted = leaves.groupBy("lang").agg(F.count("*").alias("leaves")).withColumn("all", F.lit(0).cast("long"))
    languages = cut_lineage(positions(counted, "all", ["lang"]).select("lang", F.col("at").alias("tree"), "leaves"))
    named = languages.select(F.col("lang").alias("of_lang"), "tree")
    dealt = leaves.join(named, leaves["lang"].eqNullSafe(named["of_lang"])).select("tree", "id", "digest", "claimed")
    sizes = languages.select("tree", "leaves")
    placed = cut_lineage(positions(dealt, "tree", ["id", "digest"], part_leaves))
    documents = Tree(placed, build_nodes(placed, sizes, height), sizes)
    subroots = documents.roots().select(
        F.lit(0).cast("long").alias("tree"), F.floor(F.col("tree") / part_leaves).alias("part"), F.col("tree").alias("at"),
        F.col("tree").alias("id"), "digest", F.col("digest").alias("claimed"),
    )
    top = cut_lineage(subroots)
    count = top.groupBy("tree").agg(F.count("*").alias("leaves"))
    return Manifest(languages, documents, Tree(top, build_nodes(top, count, height), count))


def _fold_hex(start: Column, sides: Column, siblings: Column) -> Column:
    """``fold`` as an expression over hex text."""
    def step(acc: Column, level: Column) -> Column:
        side = F.hex(F.substring(sides, level, F.lit(1)))
        sibling = F.lower(F.hex(F.substring(siblings, level_start(level), F.lit(32))))
        both = F.when(side == "01", F.concat(sibling, acc)).when(side == "02", F.concat(acc, sibling)).otherwise(acc)
        return F.sha2(both.cast("binary"), 256)

    def level_start(level: Column) -> Column:
        # Levels without a sibling hold no bytes.
        before = F.regexp_replace(F.hex(F.substring(sides, F.lit(1), level - 1)), "00", "")
        return (F.length(before) / 2 * 32 + 1).cast("int")

    levels = F.when(F.octet_length(sides) > 0, F.sequence(F.lit(1), F.octet_length(sides)))
    return F.aggregate(F.coalesce(levels, F.array().cast("array<int>")), start, step)


def audit(
    documents: DataFrame, tamper: int = TAMPER, id_col: str = "doc_id", source_col: str = "source",
    lang_col: str = "lang", chars_col: str = "n_chars", text_col: str = "text", height: int = HEIGHT,
    part_leaves: int = PART,
) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Documents whose id's crc32 ``tamper`` divides present a leaf with one added
    to ``n_chars`` (NULL stays NULL); ``verified`` says whether the presented
    leaf and the original siblings lead to the root. NULLs of any column are
    hashed as ``-``; a NULL id is never altered. Repeated rows are leaves of
    their own; rows of one id follow each other by digest. Texts may be empty or
    of any length. An empty table gives an empty table; further columns of the
    input play no part.
    """
    rows = pick(documents, id=id_col, source=source_col, lang=lang_col, n_chars=chars_col, text=text_col)
    plain = [F.col("id"), F.col("source"), F.col("lang")]
    altered = F.coalesce(crc_mod(F.col("id"), tamper) == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    digest = leaf_hash(*plain, F.col("n_chars"), F.col("text"))
    other = leaf_hash(*plain, F.col("n_chars") + 1, F.col("text"))
    leaves = cut_lineage(rows.select(
        "lang", "id", F.unhex(digest).alias("digest"), F.unhex(F.when(altered, other)).alias("other")
    )).select("lang", "id", "digest", F.coalesce("other", "digest").alias("claimed"))
    manifest = build(leaves, height, part_leaves)
    above = manifest.top.proofs().select(
        F.col("id").alias("tree"), F.col("top").alias("root"), F.col("sides").alias("up_sides"),
        F.col("siblings").alias("up"),
    )
    proved = manifest.documents.proofs().join(cut_lineage(above), "tree")

    def text(name: str) -> Column:
        return F.lower(F.hex(name))

    folded = _fold_hex(text("folded"), F.col("up_sides"), F.col("up"))
    return proved.select(
        F.col("id").alias("doc_id"), text("digest").alias("leaf"), text("top").alias("subroot"), text("root").alias("root"),
        F.sha2(F.concat(text("siblings"), text("up")).cast("binary"), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
