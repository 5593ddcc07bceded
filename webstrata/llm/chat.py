"""Chat formatting of logged conversations after collapsing cumulative snapshots.

A log often holds a conversation after every turn, so most entries are prefixes
of a longer one. Rolling hashes identify every prefix: the hash of the first k
turns is the sum of the hashes of (place, role, text), 128 bits in all. A
conversation goes when its hash is that of a proper prefix of some conversation
(anti-join); equal conversations keep the least id. What stays is rendered.

Only DataFrame functions are used. Conversations are handled in chunks of turn
numbers, and what earlier chunks add (turns, hash sums) comes from a summary of
one row per chunk, so a conversation of any length is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.llm.shared import pick
from webstrata.session import cut_lineage

#: Turn numbers of one chunk, and turns of one rendered part.
CHUNK = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Marker beginnings inside a text are broken up, so that a text cannot open a turn.
MARK, BROKEN = "<|im_", "<| im_"
_CONV = ["none", "conv"]
_SUMS = ["s0", "s1", "s2", "s3"]


def _halves(name: str, value: Column) -> list[Column]:
    """A 64-bit hash as two numbers whose sums stay far from the limit of a long."""
    return [
        F.shiftright(value, 32).alias(f"{name}h"), value.bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"{name}l"),
    ]


def prefixes(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every turn with its place (from 1), its conversation's length and the
    prefix hash up to it (``s0`` to ``s3``); repeated rows count once."""
    rows = pick(conversations, id=conv_col, turn=turn_col, role=role_col, text=text_col).select(
        F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).cast("long").alias("conv"),
        "turn", "role", "text", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**62))).alias("chunk"),
    )
    chunk = Window.partitionBy(*_CONV, "chunk").orderBy("turn", "role", "text")
    whole = F.struct("turn", "role", "text")
    once = rows.withColumn("again", F.lag(whole).over(chunk).eqNullSafe(whole)).where("NOT again").drop("again")
    local = once.withColumn("pos", F.row_number().over(chunk).cast("long"))
    along, conv = Window.partitionBy(*_CONV).orderBy("chunk"), Window.partitionBy(*_CONV)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    counts = local.groupBy(*_CONV, "chunk").agg(F.count("*").alias("n")).select(
        *_CONV, "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.sum("n").over(conv).alias("turns")
    )
    placed = local.join(counts, [*_CONV, "chunk"]).withColumn("pos", F.col("pos") + F.col("base")).drop("base")
    # The hash function passes over NULLs, so a NULL is told by a flag of its own.
    role, text = ([F.col(c).isNull(), F.coalesce(F.col(c), F.lit(""))] for c in ("role", "text"))
    hashed = placed.select(
        "*", *_halves("a", F.xxhash64("pos", *role, *text)), *_halves("b", F.xxhash64(*text, F.lit("b"), *role, "pos"))
    )
    parts = ["ah", "al", "bh", "bl"]
    upto = Window.partitionBy(*_CONV, "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.select(
        *[c for c in placed.columns], *[F.sum(p).over(upto).alias(s) for p, s in zip(parts, _SUMS, strict=True)]
    )
    totals = hashed.groupBy(*_CONV, "chunk").agg(*[F.sum(p).alias(p) for p in parts]).select(
        *_CONV, "chunk", *[F.coalesce(F.sum(p).over(earlier), F.lit(0)).alias(p) for p in parts]
    )
    joined = summed.join(totals, [*_CONV, "chunk"])
    return joined.select(
        *_CONV, "turn", "role", "text", "pos", "turns",
        *[(F.col(s) + F.col(p)).alias(s) for p, s in zip(parts, _SUMS, strict=True)],
    )


def maximal(turns: DataFrame) -> DataFrame:
    """(none, conv) of the conversations that are no proper prefix of another one,
    the least id of equal ones; a NULL id comes last."""
    key = ["pos", *_SUMS]
    ends = turns.where("pos = turns").groupBy(*key).agg(F.min(F.struct(*_CONV)).alias("c"))
    inner = turns.where("pos < turns").select(*key).distinct()
    return ends.join(inner, key, "left_anti").select("c.none", "c.conv")


def segment(role: Column, text: Column) -> Column:
    return F.concat(
        F.lit(OPEN), F.replace(F.coalesce(role, F.lit("unknown")), F.lit(MARK), F.lit(BROKEN)), F.lit("\n"),
        F.replace(F.coalesce(text, F.lit("")), F.lit(MARK), F.lit(BROKEN)), F.lit(CLOSE),
    )


def render(conversations: DataFrame, conv_col: str = "conv_id", **columns) -> DataFrame:
    """Maximal conversations as text: id, part, turns, text.

    Turns are ordered by number, then role, then text; a NULL number comes
    first. A conversation is one row, one more for every further ``CHUNK``
    turns: ``part`` counts from 0 and the parts put together are the text. NULL
    roles are written ``unknown``, NULL texts are empty; rows without an id are
    one conversation. Repeated rows count once; an empty table gives an empty
    table; further columns play no part.
    """
    turns = cut_lineage(prefixes(conversations, conv_col, **columns))
    kept = turns.join(maximal(turns), _CONV, "left_semi")
    lines = kept.select(
        *_CONV, ((F.col("pos") - 1) / CHUNK).cast("int").alias("part"), "turns",
        F.struct("pos", segment(F.col("role"), F.col("text")).alias("line")).alias("line"),
    )
    # At most CHUNK lines meet here.
    parts = lines.groupBy(*_CONV, "part", "turns").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    id_ = F.when(~F.col("none"), F.col("conv"))
    return parts.select(
        id_.alias(conv_col), "part", "turns", F.array_join(F.col("lines.line"), "").alias("text")
    )
