"""Matching against the one-case-at-a-time rule, and its guarantees when one group holds most people."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest

from cohortspark.operators import matching
from cohortspark.storage import Scratch

START = dt.date(2010, 1, 1)
SCHEMA = "person_id bigint, gender_concept_id bigint, age int, enroll_date date"


def people(rng, n, first_id, days=200, ages=(40, 60), hot=0.0):
    rows = []
    for i in range(n):
        if rng.random() < hot:
            rows.append((first_id + i, 1, 50, START + dt.timedelta(days=100)))
        else:
            rows.append((first_id + i, rng.choice([1, 2]), rng.randint(*ages), START + dt.timedelta(days=rng.randint(0, days))))
    return rows


def eligible(case, person):
    return (case[2] == person[1] and abs(case[3] - person[2]) <= 5 and abs((case[4] - person[3]).days) <= 30)


def preferences(case, pool, seed=42):
    """The case's candidates in its order, from the definition: turns of a power of two, scrambled."""
    listed = sorted((p for p in pool if eligible(case, p)), key=lambda p: (p[2], p[3], p[0] % 256, p[0]))
    bits = len(bin(max(len(listed) - 1, 0))) - 2
    for turn in range(1 << bits if listed else 0):
        x = turn
        for times, of_case, of_seed in matching._SCRAMBLE:
            x = (x * times + case[0] * of_case + seed * of_seed) % (1 << bits)
            x ^= x >> 1 + bits // 2
        if x < len(listed):
            yield listed[x][0]


def one_at_a_time(cases, pool, k, seed=42):
    taken, out = set(), set()
    for case in sorted(cases):
        mine = [p for p in preferences(case, pool, seed) if p not in taken][:k]
        taken.update(mine)
        out.update((case[0], p) for p in mine)
    return out


def run(spark, cases, pool, **options):
    case_df = spark.createDataFrame(cases, "case_number bigint, " + SCHEMA)
    pool_df = spark.createDataFrame(pool, SCHEMA)
    rows = matching.match_controls(case_df, pool_df, Scratch(spark), **options).collect()
    assert len({(r["case_number"], r["person_id"]) for r in rows}) == len(rows)
    return {(r["case_number"], r["person_id"]) for r in rows}


def numbered(rows):
    return [(i, *row) for i, row in enumerate(rows, start=1)]


@pytest.mark.parametrize("seed, hot", [(1, 0.0), (2, 0.4), (3, 0.9)])
def test_equals_serving_cases_one_by_one(spark, seed, hot):
    rng = random.Random(seed)
    pool = people(rng, 300, 1000, hot=hot)
    cases = numbered(people(rng, 90, 1, hot=hot))
    assert run(spark, cases, pool, seed=seed) == one_at_a_time(cases, pool, 4, seed)


def check_guarantees(pairs, cases, pool):
    person, case_of, held, holder = {p[0]: p for p in pool}, {c[0]: c for c in cases}, defaultdict(list), {}
    for case, who in pairs:
        assert eligible(case_of[case], person[who])
        assert who not in holder
        holder[who] = case
        held[case].append(who)
    assert max(len(v) for v in held.values()) <= 4
    for case in cases:
        if len(held[case[0]]) < 4:
            # Short only because lower-numbered cases hold everybody else it could take.
            assert all(holder.get(p[0], len(cases) + 1) <= case[0] for p in pool if eligible(case, p))


def crowded(seed=4):
    """Forty separate groups of very different crowding."""
    rng = random.Random(seed)
    pool, cases = [], []
    for group in range(1, 41):
        hot, days = rng.choice([0.0, 0.3, 0.6, 0.95]), rng.choice([40, 120, 200])
        pool += [(p, group, *rest) for p, _, *rest in people(rng, rng.randint(10, 60), 10_000 + 100 * group, days, hot=hot)]
        cases += [(p, group, *rest) for p, _, *rest in people(rng, rng.randint(5, 50), 100 * group, days, hot=hot)]
    rng.shuffle(cases)
    return numbered(cases), pool


def test_every_order_is_a_permutation():
    rng = random.Random(2)
    for n in (1, 2, 3, 20, 64, 65, 500):
        pool = [(i, 1, 50, START) for i in range(1, n + 1)]
        for _ in range(5):
            case = (rng.randint(1, 10 ** 9), 0, 1, 50, START)
            assert sorted(preferences(case, pool)) == list(range(1, n + 1))


def test_page_size_changes_nothing(spark):
    one_cell = numbered([(i, 1, 50, START) for i in range(1, 61)]), [(1000 + i, 1, 50, START) for i in range(150)]
    for (cases, pool), pages in ((crowded(), (5, 64)), (one_cell, (5, 1 << 20))):
        expected = one_at_a_time(cases, pool, 4)
        check_guarantees(expected, cases, pool)
        for page in pages:
            assert run(spark, cases, pool, page=page) == expected


def test_blocks_of_any_size_give_the_same_matching(spark, monkeypatch):
    rng = random.Random(21)
    pool = people(rng, 200, 1000, hot=0.8)
    cases = numbered(people(rng, 120, 1, hot=0.8))
    expected = one_at_a_time(cases, pool, 4)
    assert run(spark, cases, pool) == expected
    monkeypatch.setattr(matching, "_BLOCK_BITS", 2)
    assert run(spark, cases, pool) == expected


def test_draws_are_spread_evenly(spark):
    """Forty separate groups, each with one case and twenty controls: every place is about equally likely."""
    pool = [(100 * g + i, g, 50, START + dt.timedelta(days=i)) for g in range(1, 41) for i in range(20)]
    cases = [(g, 50_000 + g, g, 50, START + dt.timedelta(days=10)) for g in range(1, 41)]
    pairs = run(spark, cases, pool)
    counts = defaultdict(int)
    for _, who in pairs:
        counts[who % 100] += 1
    assert len(pairs) == 160 and len(counts) == 20 and max(counts.values()) <= 20


def test_bounds_are_closed(spark):
    pool = [(1, 1, 45, START), (2, 1, 55, START), (3, 1, 44, START), (4, 1, 56, START), (5, 2, 50, START),
            (6, 1, 50, START + dt.timedelta(days=30)), (7, 1, 50, START - dt.timedelta(days=30)),
            (8, 1, 50, START + dt.timedelta(days=31)), (9, None, 50, START)]
    cases = [(1, 100, 1, 50, START)]
    assert {p for _, p in run(spark, cases, pool)} == {1, 2, 6, 7}


def test_counts_of_candidates_need_no_listing(spark):
    rng = random.Random(9)
    pool, cases = people(rng, 400, 1000, hot=0.5), numbered(people(rng, 60, 1, hot=0.3))
    case_df = spark.createDataFrame(cases, "case_number bigint, " + SCHEMA)
    rows = matching.candidate_counts(case_df, spark.createDataFrame(pool, SCHEMA)).collect()
    assert {r["case_number"]: r["candidates"] for r in rows} == {c[0]: sum(eligible(c, p) for p in pool) for c in cases}


def test_no_cases_and_no_pool(spark):
    assert run(spark, [(1, 1, 1, 50, START)], [(5, 2, 50, START)]) == set()


def test_rules_that_never_decide(study):
    """Every pool member's first value lies inside the range, and nobody in the pool has an index date."""
    from cohortspark.operators.relational import group_extreme
    pool = study.pool.select("person_id", "enroll_date")
    first = group_extreme(study.labs.join(pool, "person_id"), "person_id", "measurement_date")
    assert first.filter("value < 0.5 OR value > 4.5").count() == 0
    assert pool.join(study.cases, "person_id").count() == 0


def test_every_round_has_the_same_plan(spark, monkeypatch):
    plans = []
    real = matching._round

    def watched(*args, **options):
        out = real(*args, **options)
        plans.append(out._jdf.queryExecution().optimizedPlan().numberedTreeString().count("\n"))
        return out
    monkeypatch.setattr(matching, "_round", watched)
    cases, pool = numbered([(i, 1, 50, START) for i in range(1, 31)]), [(1000 + i, 1, 50, START) for i in range(125)]
    assert run(spark, cases, pool, page=2) == one_at_a_time(cases, pool, 4)
    assert len(plans) >= 5 and len(set(plans[1:])) == 1
