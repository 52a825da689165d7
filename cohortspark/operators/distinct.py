"""Exact numbers of distinct persons that merge across sites and increments.

Persons are bits of bitmaps, one bitmap for every 32,768 consecutive ids. A stage's bitmaps are some kilobytes for each such
range, are combined by OR in any order, and count every person once however many sites or increments know it, without
reading persons again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark import constants as k


def person_bitmaps(people: DataFrame, *by: str, key: str = "person_id") -> DataFrame:
    """(by, bucket, bits) of the distinct keys; missing keys are left out, as in a distinct count. Tasks build their own bitmaps
    before the shuffle."""
    known = people.filter(F.col(key).isNotNull())
    return known.groupBy(*by, F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))


def merged(tables: Sequence[DataFrame], *by: str) -> DataFrame:
    """Bitmaps of several sites or increments as one set."""
    return reduce(DataFrame.unionByName, tables).groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(bitmaps: DataFrame, *by: str, name: str = "persons") -> DataFrame:
    """The number of distinct keys; without ``by`` one row, also for no bitmaps."""
    return bitmaps.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias(name))


def attrition_bitmaps(person: DataFrame, screened: DataFrame, cases: DataFrame, matches: DataFrame) -> DataFrame:
    """The persons of each of the ten lines of the attrition table, as (no, bucket, bits)."""
    # A screened person stands in line 2 and in one more line for every rule that it passes in turn.
    passed = screened.select("person_id", F.explode(F.sequence(F.lit(2), F.col("passed") + 2)).alias("no"))
    lines: Mapping[int, DataFrame] = {1: person, 9: cases, 10: matches}
    rows = [df.select("person_id", F.lit(no).alias("no")) for no, df in lines.items()]
    return person_bitmaps(reduce(DataFrame.unionByName, [passed, *rows]), "no")


def attrition_of(bitmaps: DataFrame) -> DataFrame:
    """The attrition table of (merged) bitmaps; a line without persons is 0."""
    labels = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(label).alias("name")) for i, label in enumerate(k.ATTRITION_LABELS, start=1)])
    every = bitmaps.sparkSession.range(1).select(F.inline(labels))
    return every.join(counted(bitmaps, "no", name="number"), "no", "left").select("no", "name", F.coalesce("number", F.lit(0)).alias("number"))
