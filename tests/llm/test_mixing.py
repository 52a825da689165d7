from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import mixing


def level_targets(sizes, share=1.5, epochs=2):
    """Resharing, step by step: what a source cannot take goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > epochs * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: float(epochs * sizes[s]) for s in over}
        left -= sum(epochs * sizes[s] for s in over)
        free -= over
    return out


def run(scratch, df):
    sized = scratch.cut(mixing.measured(df, columns=["doc_id"]), "sizes")
    return mixing.taken(sized, mixing.cuts(scratch, sized)).select("doc.doc_id", "size", "target", "taken").collect()


def rows_of(seed, n=400):
    r = random.Random(seed)
    sources = ["hot"] * 6 + ["b", "é", "Z", "𝄞", None, "tiny"]
    return [(i, " ".join("w" * r.randint(1, 9) for _ in range(r.choice([0, 1, 5, 40, 300])) ), "en", r.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_budgets(scratch, docs_of, seed):
    data = rows_of(seed)
    rows = run(scratch, docs_of(data))
    sizes, taken, targets = {}, {}, {}
    source = {d[0]: d[3] for d in data}
    for r in rows:
        s = source[r["doc_id"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
        targets[s] = r["target"]
    expected = level_targets(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(expected[s], rel=1e-9)
        assert abs(taken[s] - targets[s]) <= 1
    assert sorted(map(str, run(scratch, docs_of(data).repartition(7)))) == sorted(map(str, rows))


def test_edge_cases(scratch, docs_of):
    assert run(scratch, docs_of([])) == []
    assert [r["taken"] for r in run(scratch, docs_of([(1, None), (2, ""), (3, " \n")]))] == [0, 0, 0]
    copies = run(scratch, docs_of([(1, "a b c d e")] * 50 + [(None, None, "en", None)]))
    assert sum(r["taken"] for r in copies) in range(375 - 50, 376)
    long = run(scratch, docs_of([(1, "w " * 70_000), (2, "w")]))
    assert sum(r["taken"] for r in long) == round(1.5 * 70_001)


def test_mix_repeats_rows_and_cuts_one(scratch, docs_of):
    df = docs_of(rows_of(3)).withColumn("size", F.lit("x")).withColumn("key", F.lit("y"))
    mixed = mixing.mix(scratch, df)
    assert mixed.columns == df.columns
    wanted = {r["doc_id"]: (r["size"], r["taken"]) for r in run(scratch, df)}
    got, texts = {}, {}
    for r in mixed.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
        texts.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {d: t for d, (_, t) in wanted.items() if t}
    whole = {d[0]: d[1] for d in rows_of(3)}
    cut = [(d, t) for d, all_ in texts.items() for t in all_ if t != whole[d]]
    assert all(whole[d].startswith(t) for d, t in cut) and len(cut) <= 7
