"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import uuid
import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.session import cut_lineage, ship_package

__all__ = [
    "LOCATION", "crc_mod", "fresh", "join_lines", "labelled_sample", "line_maps", "located", "pick", "python_crc_mod",
    "ship_package", "stretch",
]


def fresh(name: str) -> str:
    """A column name that no input table holds."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names.

    Everything else of the input, whatever it is called, stays out of the work.
    """
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


#: Columns that tell where a row is stored: its file (128 bits of hash) and place in it.
LOCATION = ("__file", "__file_check", "__line")


def located(df: DataFrame) -> tuple[DataFrame, list[Column]]:
    """``df`` as a table of Parquet files, and where each row is stored.

    A table that was read from files is taken as it is, so its rows are told
    apart without writing them anew; one of another kind, or in which a stored row
    occurs more than once, is written first.
    """
    def place(table: DataFrame) -> list[Column]:
        meta = table.metadataColumn("_metadata")
        columns = F.xxhash64(meta["file_path"]), F.xxhash64(meta["file_path"], F.lit(1)), meta["row_index"]
        return [c.alias(n) for c, n in zip(columns, LOCATION, strict=True)]

    try:
        # Only the places are read, none of the table's columns.
        once = df.select(*place(df)).groupBy(*LOCATION).count().where("count > 1").isEmpty()
    except AnalysisException:
        once = False
    df = df if once else cut_lineage(df)
    return df, place(df)


#: Lines of a file that share a bitmap (``bitmap_construct_agg`` takes up to 32,768), as a power of two.
_MAP_BITS = 12
_MAP = ("__map_file", "__map_check", "__map")


def line_maps(places: DataFrame, *also: str) -> DataFrame:
    """The rows ``places`` (LOCATION and ``also``) as bitmaps, for ``join_lines``.

    One row per run of lines of a file and values of ``also``, with a bit per line:
    about a bit for every stored row, where a list of places takes 24 bytes for
    each that it names.
    """
    file, check, line = map(F.col, LOCATION)
    keyed = places.select(
        file.alias(_MAP[0]), check.alias(_MAP[1]), F.shiftright(line, _MAP_BITS).alias(_MAP[2]),
        F.pmod(line, F.lit(1 << _MAP_BITS)).alias("bit"), *also,
    )
    # Dealt by key first: bitmaps begun in every task would all be shuffled.
    maps = keyed.repartition(*_MAP).groupBy(*_MAP, *also).agg(F.bitmap_construct_agg("bit").alias("bits"), F.max("bit").alias("last"))
    filled = F.substring("bits", F.lit(1), (F.shiftright("last", 3) + 1).cast("int"))
    return maps.select(*_MAP, *also, filled.alias("__bits"))


def join_lines(table: DataFrame, place_of: list[Column], maps: DataFrame, how: str) -> DataFrame:
    """``table`` with its places, joined to the written ``maps`` that hold its rows.

    Maps are small beside the table, so that Spark sends them to it and its rows
    stay where they are; beyond the broadcast threshold both sides are shuffled.
    """
    file, check, line = map(F.col, LOCATION)
    at = F.pmod(line, F.lit(1 << _MAP_BITS)).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, F.pmod(at, F.lit(8))) == 1
    same = (file == F.col(_MAP[0])) & (check == F.col(_MAP[1])) & (F.shiftright(line, _MAP_BITS) == F.col(_MAP[2]))
    return table.select("*", *place_of).join(maps, same & held, how)


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; NULL ids give NULL."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def python_crc_mod(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def stretch(text: Column, id_: Column, chars: int) -> Column:
    """At most ``chars`` characters of a text: all of a shorter one, else a run that starts at a place given by the id."""
    room = F.length(text) - chars
    start = F.pmod(F.crc32(id_.cast("string").cast("binary")), F.greatest(room, F.lit(1))) + 1
    return F.when(room > 0, F.substring(text, start.cast("int"), F.lit(chars))).otherwise(text)


def whole_lines(text: str, cut: bool) -> str:
    """A cut text without the lines at its ends, which may be parts of lines."""
    lines = text.split("\n")
    return "\n".join(lines[1:-1]) if cut and len(lines) > 2 else text


def labelled_sample(
    documents: DataFrame, labels: DataFrame, modulus: int, held_out: int, sample: int, sample_chars: int,
    id_col: str, text_col: str, label_col: str,
) -> list[tuple[int, bytes, float]]:
    """(id, UTF-8 text, label) of labelled documents that are not held out.

    The first ``sample`` labelled ids with a text by md5 of the id, those with a
    text of at most ``sample_chars`` characters before all others; of a longer
    text a stretch of whole lines is taken. NULL ids, labels and texts teach
    nothing; of repeated ids the least label and text count. The result is at most
    ``sample * sample_chars`` characters whatever the corpus size.
    """
    known = pick(labels, id=id_col, label=label_col).where(
        F.col("label").isNotNull() & (crc_mod(F.col("id"), modulus) != held_out)
    ).groupBy("id").agg(F.min("label").alias("label"))
    texts = pick(documents, id=id_col, text=text_col).where("text IS NOT NULL")
    sized = texts.select("id", F.length("text").alias("size")).join(known, "id").groupBy("id", "label").agg(
        F.min("size").alias("size")
    )
    order = [F.col("size") > sample_chars, F.md5(F.col("id").cast("string")), "id"]
    wanted = {r["id"]: r["label"] for r in sized.orderBy(*order).limit(sample).collect()}
    ids = documents.sparkSession.createDataFrame([(i,) for i in wanted], known.select("id").schema)
    cut = texts.join(F.broadcast(ids), "id").select(  # at most ``sample`` ids
        "id", F.struct(F.length("text") > sample_chars, stretch(F.col("text"), F.col("id"), sample_chars)).alias("t")
    )
    found = cut.groupBy("id").agg(F.min("t").alias("t")).collect()
    return sorted((r["id"], whole_lines(r["t"][1], r["t"][0]).encode(), wanted[r["id"]]) for r in found)
