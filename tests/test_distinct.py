"""Counts of distinct persons that merge."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cohortspark.operators import distinct


def test_halves_with_shared_persons_merge_to_the_whole(spark, study):
    expected = [(r["no"], r["name"], r["number"]) for r in study.attrition.orderBy("no").collect()]
    tables = study.tables.person, study.screened, study.cases, study.matches
    parts = []
    for wanted in ("person_id % 3 <> 0", "person_id % 3 <> 1"):   # a third of the persons is in both
        parts.append(distinct.attrition_bitmaps(*[t.filter(wanted) for t in tables]))
    for bitmaps in (study.attrition_bitmaps, distinct.merged(parts, "no"), distinct.merged([*parts, parts[0]], "no")):
        assert [tuple(r) for r in distinct.attrition_of(bitmaps).orderBy("no").collect()] == expected


def test_ids_of_any_size_and_no_rows(spark):
    rng = random.Random(3)
    ids = [rng.choice([rng.randint(-70_000, 70_000), rng.randint(-2 ** 62, 2 ** 62), 0, 1, 32_768, 32_769]) for _ in range(3000)]
    people = spark.createDataFrame([(i, i % 4) for i in ids] + [(None, 0)], "person_id bigint, stage int").repartition(5)
    assert distinct.counted(distinct.person_bitmaps(people)).first()["persons"] == len(set(ids))
    by = {r["stage"]: r["n"] for r in distinct.counted(distinct.person_bitmaps(people, "stage"), "stage", name="n").collect()}
    assert by == {s: len({i for i in ids if i % 4 == s}) for s in range(4)}
    assert distinct.counted(distinct.person_bitmaps(people.filter("false"))).first()["persons"] == 0
    assert distinct.attrition_of(distinct.person_bitmaps(people.filter("false").withColumn("no", F.lit(1)), "no")).agg(F.sum("number")).first()[0] == 0
