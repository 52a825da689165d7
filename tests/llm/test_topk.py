from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from compare import difference
from pyspark.sql import functions as F

from cohortspark.llm.oracle import OP6
from cohortspark.llm.topk import _TASK_NUMBERS, _grid, _within_reach, top_k

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    import numpy as np

    usable = []
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, tuple(math.floor(1024 * Fraction(float(np.float32(x)))) for x in v)))
    out = []
    for i, v in dict.fromkeys(usable):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != i and len(w) == len(v))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def vectors(seed, n=900, dim=8):
    r = random.Random(seed)
    hot = [r.gauss(0, 1) for _ in range(dim)]
    rows = [(i, hot if r.random() < 0.33 else [r.gauss(0, r.choice([0.1, 1, 50])) for _ in range(dim)]) for i in range(n)]
    rows += [(None, hot), (2000, None), (2001, []), (2002, [float("nan")] * dim), (2003, [float("inf")] + [0.0] * (dim - 1)),
             (2004, [None] + [1.0] * (dim - 1)), (2010, [1.0, 2.0]), (2020, [3.0, 4.0]), (2030, [300_000.0] * dim), (0, rows[0][1]), (10, [0.5] * dim)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, scratch, seed):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit(1)).withColumn("ids", F.lit("x"))
    expected = brute(rows, 10, 10)
    for sizes in ({}, {"block_rows": 50, "query_rows": 7, "shards": 4, "step": 16, "pivots": 3}):
        found = top_k(scratch, df, every=10, **sizes).collect()
        assert sorted(map(tuple, found)) == expected


def test_large_components_are_exact(spark, scratch):
    rows = [(i, [float(2 ** 17 + i), float(2 ** 17 - 3 * i), 1.0 / (i + 1)]) for i in range(40)]
    found = top_k(scratch, spark.createDataFrame(rows, SCHEMA), every=4).collect()
    assert sorted(map(tuple, found)) == brute(rows, 4, 10)


def test_few_and_no_rows(spark, scratch):
    few = top_k(scratch, spark.createDataFrame([(0, [1.0]), (1, [2.0])], SCHEMA)).collect()
    assert list(map(tuple, few)) == [(0, 1, 1, 1024 * 2048)]
    assert top_k(scratch, spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("rows", [
    [(0, [300_000.0, 1.0]), (1, [300_000.0, 2.0]), (10, [1.0, 1.0])],
    [(0, [1e30, 0.0, 1.0]), (1, [0.0, 1e30, 2.0]), (10, [0.0, 0.0, 3.0]), (11, [0.0, -1e30, -1.0])],   # only the sums must fit
    [(i, [262143.9 * (-1) ** (i + j) for j in range(383 + i)][:383]) for i in (0, 2, 4, 6)],
    [(0, [2.0 ** 20 + i for i in range(40)]), (1, [-(2.0 ** 20) - i for i in range(40)]), (2, [2.0 ** 21] * 40), (10, [0.25] * 40)]])
def test_components_of_any_size_are_exact(spark, scratch, rows):
    try:
        expected = brute(rows, 10, 10)
        assert all(-2 ** 63 <= r[3] < 2 ** 63 for r in expected)
    except AssertionError:
        with pytest.raises(Exception, match="does not fit a long"):
            top_k(scratch, spark.createDataFrame(rows, SCHEMA), every=10).collect()
    else:
        assert sorted(map(tuple, top_k(scratch, spark.createDataFrame(rows, SCHEMA), every=10).collect())) == expected


def test_a_score_beyond_a_long_is_an_error(spark, scratch):
    rows = [(0, [262143.9] * 384), (1, [262143.9] * 384)]
    assert brute(rows, 100, 10)[0][3] > 2 ** 63
    with pytest.raises(Exception, match="does not fit a long"):
        top_k(scratch, spark.createDataFrame(rows, SCHEMA)).collect()
    # Outside the best k it does not matter.
    rows += [(i, [float(i)] * 384) for i in range(2, 40)]
    low = [(0, [-262143.9] * 384), *rows[1:]]
    assert sorted(map(tuple, top_k(scratch, spark.createDataFrame(low, SCHEMA)).collect())) == brute(low, 100, 10)


def test_every_repeated_row_is_a_candidate_as_in_sql(spark, scratch, tmp_path):
    import duckdb

    r = random.Random(6)
    rows = [(i % 150, [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(260)]
    rows += rows[:120] + [(500, [9.0] * 4)] * 30 + [(100, [1.0, 2.0, 3.0, 4.0])] * 3 + [(7, [300_000.0] * 4), (8, []), (9, [1.0]), (200, [2.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings/*.parquet')")
    assert difference(top_k(scratch, df, block_rows=40, query_rows=2, shards=3), con, OP6) is None
    assert sorted(map(tuple, top_k(scratch, df).collect())) == brute(rows, 100, 10)


def test_queries_are_not_sent_through_the_driver(spark, scratch):
    rows = vectors(3)
    found = top_k(scratch, spark.createDataFrame(rows, SCHEMA), every=10, block_rows=50, query_rows=7, shards=4)
    assert sorted(map(tuple, found.collect())) == brute(rows, 10, 10)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in plan and "CartesianProduct" in plan and "Broadcast" not in plan


def test_partitions_follow_the_work_and_queries_are_divided():
    assert _grid(0, 1, 0, 1, 200, None) == (1, 1)
    assert _grid(10 ** 6, 301, 400, 25, 200, None) == (1, 1)
    shards, q_shards = _grid(615_384 * 6_154, 301, 6_154 * 64, 25, 600, None)
    assert 50 <= shards * q_shards <= 80
    shards, q_shards = _grid(10 ** 7 * 10 ** 5, 4_883, 10 ** 5 * 64, 391, 500, None)
    assert 1_000 <= shards * q_shards <= 1_100 and shards <= 130
    # What a task holds about its queries is bounded, however few partitions there are.
    assert _grid(10 ** 6, 301, 100 * _TASK_NUMBERS, 1_000, 1, None) == (1, 100)
    assert _grid(10 ** 12, 301, 400, 25, 200, 4) == (4, 25)


def test_queries_and_candidates_in_many_partitions(spark, scratch):
    r = random.Random(8)
    centres = [[r.gauss(0, 30) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, r.choice([0.01, 1])) for c in centres[i % 5]]) for i in range(700)]
    rows += [(i, [r.gauss(0, 1)] * 3) for i in range(700, 800)]
    df = spark.createDataFrame(rows, SCHEMA)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert sorted(map(tuple, top_k(scratch, df, every=5, k=3, block_rows=30, query_rows=9, step=8).collect())) == brute(rows, 5, 3)
            assert sorted(map(tuple, top_k(scratch, df, every=5, k=3, block_rows=30, query_rows=9, step=7, shards=5).collect())) == brute(rows, 5, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_components_whose_squares_no_double_holds(spark, scratch):
    r = random.Random(9)
    rows = [(i, [float(r.randint(1, 9)), float(r.randint(-9, 9))]) for i in range(60)]
    rows += [(101 + i, [-(10.0 ** e), 0.0]) for i, e in enumerate((100, 155, 200, 300))]   # scores far below those of the result
    whole = [(i, [math.floor(1024 * Fraction(c)) for c in v]) for i, v in rows]
    expected = []
    for i, v in whole[:60:10]:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i)[:10]
        expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, top_k(scratch, df, every=10, step=5).collect())) == expected


def test_a_vector_that_most_rows_have(spark, scratch):
    import numpy as np

    r = random.Random(10)
    hot = [1.0, -2.0, 3.0]
    rows = [(i, hot if r.random() < 0.8 else [r.gauss(0, 3) for _ in range(3)]) for i in range(1500)]
    rows += [(i, hot) for i in range(0, 60, 4)] + [(i, [0.5, 0.5, 0.5]) for i in range(0, 30, 10)]   # repeated rows, ids of two vectors
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for sizes in ({}, {"block_rows": 400, "query_rows": 30, "shards": 3, "k": 3}):
        assert sorted(map(tuple, top_k(scratch, df, every=10, **sizes).collect())) == brute(rows, 10, sizes.get("k", 10))
    vectors = np.array([[1.0, 2.0]] * 6 + [[2.0, 1.0]] * 2)
    assert _within_reach(vectors, np.array([9, 4, 7, 1, 8, 2, 5, 3]), 2).tolist() == [1, 3, 5, 6, 7]
