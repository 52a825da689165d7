"""Ordered and grouped building blocks that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.functions import na_agg
from cohortspark.storage import Scratch


def first_event(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the order (give a total order for a reproducible choice).

    Spark turns the filter on the row number into a group limit before the shuffle, so each map task sends
    one row per key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return sample_per_group(df, keys, order, 1)


def sample_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], size: int) -> DataFrame:
    """The first ``size`` rows of every group; with a hash order this is a seeded random sample."""
    rows = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(rows)).filter(F.col("_row") <= size).drop("_row")


def seeded_order(seed: int, *columns: str) -> Column:
    """A random order that any engine reproduces: the md5 of the seed and the key columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def group_extreme(df: DataFrame, key: str, value: str, *, largest: bool = False) -> DataFrame:
    """All rows that equal their group's smallest (or largest) value, ties kept; rows without a key or value are left out.

    The rows are read once. Spark turns the filter on the rank into a group limit before the shuffle, so each map task
    sends only the rows that tie for its own extreme.
    """
    order = F.col(value).desc() if largest else F.col(value).asc()
    known = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    return (known.withColumn("_rank", F.rank().over(Window.partitionBy(key).orderBy(order)))
            .filter(F.col("_rank") <= 1).drop("_rank"))


def mean_and_n(df: DataFrame, value: str, mean_name: str = "value") -> DataFrame:
    """Mean (NULL if any value is missing) and number of rows of the whole table."""
    return df.agg(na_agg(F.avg, value).alias(mean_name), F.count(F.lit(1)).alias("n"))


def number_rows(df: DataFrame, order: str, name: str, scratch: Scratch) -> DataFrame:
    """Number the rows 1..n in the order of a unique column, without sorting them in one task.

    Rows are range-partitioned and written with their partition number; each partition is numbered on its own
    and shifted by the size of the partitions before it.
    """
    parts = scratch.cut(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()), name)
    # One row per partition, so this window stays as small as the number of partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = (parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
             .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift")))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return (parts.join(shift, "_part")
            .withColumn(name, (F.col("_shift") + rank).cast("bigint"))
            .drop("_part", "_shift"))
