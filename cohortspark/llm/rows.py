"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cohortspark.storage import Scratch

# The characters that separate words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def nested(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The given columns of a row (all of them by default) as one struct, so that no name can clash with a helper column."""
    return F.struct(*[F.col(f"`{c}`") for c in (df.columns if columns is None else columns)])


def unnested(df: DataFrame, struct: str, added: Sequence[str]) -> DataFrame:
    """The fields of a struct column and the added columns; an added column replaces a field of the same name."""
    taken = {a.lower() for a in added}
    fields = [f.name for f in df.schema[struct].dataType.fields if f.name.lower() not in taken]
    return df.select(*[F.col(f"{struct}.`{f}`").alias(f) for f in fields], *added)


def text_of(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def row_key(id_column: Column, text_column: Column) -> Column:
    """A 128-bit digest of a row's id and whole text. Rows that agree in both are one document."""
    return F.unhex(F.md5(F.concat(F.coalesce(id_column.cast("string"), F.lit("-")), F.lit(":"),
                                  F.when(text_column.isNull(), F.lit("0")).otherwise(F.lit("1")), text_of(text_column))))


def prefix_sums(scratch: Scratch, df: DataFrame, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Add, for each (long) value column v, ``before_v``: the sum of v over all rows that come earlier in the given order.

    Rows are range-partitioned and sorted, so a hot key spreads over partitions; each task keeps running sums while it
    streams its rows, and the totals of the partitions before are added afterwards. The only table that is summed in one
    place has one row per partition. Rows must differ in the order columns, or the sums of tied rows are interchangeable.
    """
    columns, outs = df.columns, [f"before_{v}" for v in values]
    places = [columns.index(v) for v in values]
    schema = StructType([*df.schema.fields, StructField("part", LongType()), *[StructField(o, LongType()) for o in outs]])

    def running(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        part, sums = TaskContext.get().partitionId(), [0] * len(places)
        for batch in batches:
            added = []
            for k, i in enumerate(places):
                column = batch.column(i).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(column) + sums[k]
                added.append(pa.array(ends - column, pa.int64()))
                sums[k] = int(ends[-1]) if len(ends) else sums[k]
            part_column = pa.array(np.full(batch.num_rows, part, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, part_column, *added], names=[*columns, "part", *outs])

    ranged = scratch.cut(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(running, schema), "prefix")
    totals = ranged.groupBy("part").agg(*[F.sum(v).alias(f"sum_{v}") for v in values])
    earlier = "PARTITION BY 1 ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    offsets = totals.select("part", *[F.expr(f"coalesce(sum(sum_{v}) OVER ({earlier}), 0)").alias(f"offset_{v}") for v in values])
    return ranged.join(F.broadcast(offsets), "part").select(   # one row per partition
        *columns, *[(F.col(f"before_{v}") + F.col(f"offset_{v}")).alias(f"before_{v}") for v in values])
