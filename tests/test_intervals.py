"""Windows of time against nested loops, and how a person with very many events is spread."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohortspark.operators import intervals

START = dt.date(2020, 1, 1)


def day(n):
    return None if n is None else START + dt.timedelta(days=n)


@pytest.mark.parametrize("width", [1, 7, 180, 5000])
def test_pairs_match_nested_loops(spark, width):
    rng = random.Random(width)
    maybe = lambda n: None if rng.random() < 0.08 else n
    anchors = [(i, rng.choice([1, 2, None]), maybe(a := rng.randint(-400, 400)), maybe(a + rng.randint(-3, 90))) for i in range(60)]
    events = [(i, rng.choice([1, 2, None]), maybe(a := rng.randint(-500, 500)), maybe(a + rng.randint(-10, 120))) for i in range(150)]
    events += events[:5]
    left = spark.createDataFrame([(i, p, day(a), day(b)) for i, p, a, b in anchors], "a int, person_id int, lo date, hi date")
    right = spark.createDataFrame([(i, p, day(s), day(e)) for i, p, s, e in events], "e int, person_id int, s date, t date")
    inside = lambda d, a: d is not None and a[2] <= d <= a[3]
    known = [a for a in anchors if a[2] is not None and a[3] is not None]
    points = sorted((a[0], e[0]) for a in known for e in events if a[1] is not None and a[1] == e[1] and (inside(e[2], a) or inside(e[3], a)))
    got = intervals.dates_in_windows(left, right, ["s", "t"], F.col("lo"), F.col("hi"), width=width)
    assert got.columns == ["person_id", "a", "lo", "hi", "e", "s", "t"]
    assert sorted((r["a"], r["e"]) for r in got.collect()) == points and points
    spans = sorted((a[0], e[0]) for a in known for e in events if a[1] is not None and a[1] == e[1] and a[2] <= a[3] and e[2] is not None
                   and e[2] <= a[3] and (e[3] if e[3] is not None else e[2]) >= a[2])
    met = intervals.spans_in_windows(left, right, "s", F.coalesce("t", "s"), F.col("lo"), F.col("hi"), width=width)
    assert sorted((r["a"], r["e"]) for r in met.collect()) == spans and spans


def test_a_person_with_a_million_events_is_spread_over_tasks(spark):
    events = spark.range(1_000_000).selectExpr("1L AS person_id", "id AS e", "date_add(DATE'2000-01-01', CAST(id % 7300 AS INT)) AS d")
    anchors = spark.range(40).selectExpr("1L AS person_id", "id AS a", "date_add(DATE'2000-01-01', CAST(id * 180 AS INT)) AS index")
    pairs = intervals.dates_in_windows(anchors.hint("merge"), events, ["d"], F.date_sub("index", 20), F.date_sub("index", 1), width=180)
    parts = pairs.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()
    expected = anchors.crossJoin(spark.range(7300).selectExpr("date_add(DATE'2000-01-01', CAST(id AS INT)) AS d", "1000000 DIV 7300 + int(id < 1000000 % 7300) AS n"))
    expected = expected.filter("d BETWEEN date_sub(index, 20) AND date_sub(index, 1)").agg(F.sum("n")).first()[0]
    assert sum(r["n"] for r in parts) == expected and len(parts) > 1
