"""Exact dedup: two passes around a Bloom filter; only rows whose hash may repeat are shuffled."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.rows import SPACE, nested, text_of, unnested
from cohortspark.storage import Scratch

SEGMENT_BITS = 32_768   # Spark's bitmap_construct_agg builds bitmaps of this many bits


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one space; a missing text is empty."""
    return F.regexp_replace(text_of(text), SPACE, " ")


# The place of a row among SEGMENT_BITS rows with neighbouring numbers.
CHUNK = ("shiftrightunsigned(row, 15) AS chunk", f"row & {SEGMENT_BITS - 1} AS place")


def _is_set(bit: str) -> Column:
    byte = F.conv(F.hex(F.expr(f"substring(bits, CAST({bit} DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    return F.getbit(byte, F.expr(f"CAST({bit} % 8 AS INT)")) == 1


def _flagged(joined: DataFrame, *bits: str) -> DataFrame:
    """The rows with ``may_repeat``: whether the bitmap that they met has all their bits."""
    return joined.select("doc", "id", "text_sha256", "row", F.coalesce(reduce(Column.__and__, map(_is_set, bits)), F.lit(False)).alias("may_repeat"))


def exact_dedup(scratch: Scratch, df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                columns: Sequence[str] | None = None, bits_per_row: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when their normalised forms have the same SHA-256. Of equal texts the row with the smallest id is kept.

    Texts are normalised and hashed once; the chosen columns, the hash and a row number are written. Pass 1 sets two bits per
    row in a Bloom filter and keeps the bits that two rows or more have set: a bit set once belongs to a unique row. Tasks
    combine their own bits before the shuffle, which carries bit positions only. Pass 2 probes every row in place. Rows with an
    unrepeated bit are unique and pass straight through; the rest, which holds all repeated texts and a few others, is written
    once and grouped by hash.

    The filter has ``bits_per_row`` bits a row at any number of rows, so the share of rows that are grouped does not grow. Up to
    ``max_bits`` (32 MB) it is broadcast. A larger one stays in its segments, which meet the row numbers and bit positions of all
    rows in a join; what comes back is one bit a row. These bits are broadcast in slabs of about ``max_bits`` rows, each to the
    written rows of its own slab, so that rows still do not move.

    A null text is empty. Null ids come last: a null is kept only when no equal text has an id. Of rows that repeat both id
    and text exactly one is kept. Extra columns are returned as they are; one named like an added column is replaced. An
    empty table gives an empty result. A hot group meets one summary row in a join, which adaptive execution can split.
    ``columns`` limits the returned input columns.
    """
    added = ("keep_id", "group_size", "kept", "text_sha256")
    slabs = -(-df.count() // max_bits) or 1
    hashed = scratch.cut(df.select(
        nested(df, columns).alias("doc"), F.col(f"`{id_col}`").alias("id"),
        F.sha2(normalised(F.col(f"`{text_col}`")).cast("binary"), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("row"), (F.spark_partition_id() % slabs).alias("slab")), "hashed", *(["slab"] if slabs > 1 else []))
    size = hashed.count() * bits_per_row
    segments = 1
    while segments * SEGMENT_BITS < size:
        segments *= 2
    mixed = F.xxhash64("text_sha256")
    placed = hashed.select("*", F.shiftrightunsigned(mixed, 30).bitwiseAND(F.lit(segments - 1)).alias("segment"),
                           mixed.bitwiseAND(F.lit(SEGMENT_BITS - 1)).alias("bit1"),
                           F.shiftrightunsigned(mixed, 15).bitwiseAND(F.lit(SEGMENT_BITS - 1)).alias("bit2"))

    marks = placed.select("segment", F.explode(F.array_distinct(F.array("bit1", "bit2"))).alias("bit"))
    repeated_bits = marks.groupBy("segment", "bit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    filters = scratch.cut(repeated_bits.groupBy("segment").agg(F.bitmap_construct_agg("bit").alias("bits")), "filter")
    if segments * SEGMENT_BITS <= max_bits:
        probed = _flagged(placed.join(F.broadcast(filters), "segment", "left"), "bit1", "bit2")   # at most max_bits / 8 bytes
    else:
        probes = placed.select("slab", "row", "segment", "bit1", "bit2").join(filters.hint("merge"), "segment")
        repeated = probes.filter(_is_set("bit1") & _is_set("bit2")).selectExpr("slab", *CHUNK)
        flags = scratch.cut(repeated.groupBy("slab", "chunk").agg(F.bitmap_construct_agg("place").alias("bits")), "flags", "slab")
        probed = reduce(DataFrame.unionAll, [
            _flagged(hashed.filter(F.col("slab") == slab).selectExpr("*", *CHUNK).join(
                F.broadcast(flags.filter(F.col("slab") == slab).drop("slab")), "chunk", "left"), "place")   # a bit a row of the slab
            for slab in range(slabs)])
    maybe = scratch.cut(probed.filter("may_repeat").drop("may_repeat"), "maybe")
    # Written, so that the join reads plain shuffles of both sides, in which adaptive execution splits a hot group.
    groups = scratch.cut(maybe.groupBy("text_sha256").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    grouped = maybe.join(groups, "text_sha256").select(
        "doc", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")
    unique = probed.filter(~F.col("may_repeat")).select(
        "doc", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return unnested(unique.unionByName(grouped), "doc", added)
