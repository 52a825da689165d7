from __future__ import annotations

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import merkle

H = lambda parts: sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree(digests):
    """The root and, for each leaf, its siblings level by level."""
    level, paths, at = list(digests), [[] for _ in digests], list(range(len(digests)))
    while len(level) > 1:
        for k, i in enumerate(at):
            lo = i // 8 * 8
            paths[k].append(("".join(level[lo:i]), "".join(level[i + 1:lo + 8])))
        level, at = [H(level[i:i + 8]) for i in range(0, len(level), 8)], [i // 8 for i in at]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = []
    for g in names:
        own = sorted(((r[0] is not None, r[0] or 0, leaf_of(r)), r) for r in groups[g])
        root, paths = tree([k[2] for k, _ in own])
        made.append((root, [(r, k[2], p) for (k, r), p in zip(own, paths)]))
    top, top_paths = tree([m[0] for m in made])
    return top, sorted(((r[0], leaf, sub, [*p, *tp]) for (sub, rows), tp in zip(made, top_paths) for r, leaf, p in rows), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def proofs(scratch, df, **options):
    columns = [F.col(c) for c in ("doc_id", "lang", "text")]
    return merkle.build(scratch, df, merkle.digest_of(*columns), **options)


def compare(spark, scratch, rows):
    made = proofs(scratch, frame(spark, rows).repartition(3))
    top, expected = brute(rows)
    found = made.proofs().collect()
    assert {r["root"] for r in found} == {top} == {made.root}
    assert sorted(((r["id"], r["leaf"], r["subroot"], [(s["before"], s["after"]) for s in r["path"]]) for r in found), key=str) == expected
    return made


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_proofs_match_brute_force_over_several_passes(spark, scratch, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "PACK_BITS", 3 * levels)
    sizes = {"a": 1, "b": 8, "c": 9, "d": 64, "é": 65, "Z": 130, None: 17, "": 2, **{f"x{i}": 1 for i in range(12)}}
    rows = [(i * 7 % 1000, g, f"text {g} {i}") for g, n in sizes.items() for i in range(n)]
    # Ties, repeated rows (whole equal subtrees), nulls, an empty and a long text.
    rows += [(5, "a", "tie"), (5, "a", "tie 2"), (None, "a", "n"), (None, "a", None), (3, "", ""), (9, "b", "w " * 50_000)]
    rows += [(None, "same", "row")] * (64 * 3 + 5)
    random.Random(1).shuffle(rows)
    compare(spark, scratch, rows)


def test_one_leaf_and_no_leaf(spark, scratch):
    made = compare(spark, scratch, [(1, "en", "x")])
    assert made.root == leaf_of((1, "en", "x")) and made.records.count() == 0
    empty = proofs(scratch, frame(spark, []))
    assert empty.root is None and empty.proofs().count() == 0 and empty.records.count() == 0


def test_records_fold_up_and_single_requests_descend(spark, scratch):
    rows = [(i, "en" if i % 3 else "fr", f"t{i}") for i in range(300)] + [(None, None, None)]
    made = proofs(scratch, frame(spark, rows), carry={"tampered": F.when(F.col("doc_id") % 2 == 0, F.lit("x"))})
    records = {r["digest"]: r["children"] for r in made.records.collect()}
    assert all(H(children) == digest and 1 <= len(children) <= 8 for digest, children in records.items())
    reached, front = set(), [made.root]
    while front:
        node = front.pop()
        reached.add(node)
        front += records.get(node, [])
    assert reached == set(records) | {leaf_of(r) for r in rows}
    asked = made.proofs(spark.createDataFrame([(7,), (7,), (None,), (5000,)], "wanted long")).collect()
    assert {r["id"] for r in asked} == {7, None} and len(asked) == 2
    out = made.proofs().select("id", "root", merkle.folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded")).collect()
    assert all((r["folded"] == r["root"]) == (r["id"] is None or r["id"] % 2 == 1) for r in out)


def test_extra_columns_do_not_matter(spark, scratch):
    rows = [(i, "en", f"t{i}") for i in range(20)]
    df = frame(spark, rows)
    more = df.withColumns({c: F.lit(1) for c in ("tree", "rank", "digest", "n", "row", "one", "path", "group", "id", "leaf")})
    assert proofs(scratch, more).root == proofs(scratch, df).root
