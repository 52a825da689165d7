from __future__ import annotations

import random

from pyspark.sql import functions as F

from cohortspark.llm.lines import dedup_lines


def brute(rows, min_words):
    """Delete each line that lies in a run of enough words which also stands at an earlier place; all runs are tried."""
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows})   # rows equal in id and text are looked at apart
    seen, out = {}, {}
    for d, (no_id, i, text) in enumerate(docs):
        lines = text.split("\n")
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(x.encode().split()) for x in lines[a:b + 1]) >= min_words:
                    run = tuple(lines[a:b + 1])
                    if run in seen and seen[run] < (d, a):
                        out.setdefault((None if no_id else i, text), set()).update(range(a, b + 1))
                    seen.setdefault(run, (d, a))
    return out


def corpus():
    r = random.Random(8)
    pool = [" ".join(r.choice("abcdefgh") for _ in range(r.choice([1, 2, 3, 5, 9]))) for _ in range(25)] + ["", " ", "x\r"]
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 14)))))
    shared = "\n".join(r.choice(pool) for _ in range(6))
    rows += [(100 + i, f"begin {i}\n{shared}\nend {i}") for i in range(8)]
    rows += [(7, rows[7][1]), (None, shared), (201, None), (202, ""), (203, "same line here\n" * 30), (204, "w " * 50_000 + "\nq")]
    return rows


def test_matches_brute_force(scratch, docs_of):
    rows = corpus()
    df = docs_of(rows).withColumn("removed", F.lit("x")).withColumn("cleaned", F.lit("kept")).withColumn("key", F.lit(1))
    expected = brute(rows, 6)
    out = dedup_lines(scratch, df, min_words=6)
    assert out.columns == [*docs_of([]).columns, "cleaned", "key", "removed"]
    found = out.collect()
    assert len(found) == len(rows)
    texts = {(i, t or "") for i, t in rows}
    left = {}
    for i, t in texts:
        gone = expected.get((i, t), set())
        left.setdefault(i, set()).add("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone))
        if rows.count((i, t)) > 1 and len(t.split()) >= 6:
            left[i].add("")   # all but one of equal rows are cut
    for r in found:
        assert (r["text"] or "") in left[r["doc_id"]]
        assert r["cleaned"] == "kept"
    assert sum(len(r["removed"]) > 0 for r in found) > 20


def test_single_long_line_and_nulls(scratch, docs_of):
    passage = " ".join(f"word{i}" for i in range(51))
    rows = [(1, f"intro\n{passage}\nend"), (2, f"{passage}"), (3, "intro\nshort"), (4, None), (5, None)]
    found = {r["doc_id"]: r for r in dedup_lines(scratch, docs_of(rows)).collect()}
    assert found[1]["removed"] == [] and [tuple(s) for s in found[2]["removed"]] == [(0, 0)]
    assert found[2]["text"] == "" and found[3]["text"] == "intro\nshort" and found[4]["text"] is None
    assert dedup_lines(scratch, docs_of([])).count() == 0


def test_all_but_one_of_equal_rows_are_cut(spark, scratch, tmp_path):
    import duckdb
    from compare import difference

    from cohortspark.llm.oracle import OP2

    line, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "wv")
    rows = ([(None, line)] * 5 + [(3, f"{line}\nshort")] * 3 + [(4, f"a\n{other}\nb")] * 2 + [(2, other)] + [(5, "few words")] * 4
            + [(None, None)] * 3 + [(6, None), (6, None)] + [(7, f"x\n{other}"), (7, f"y\n{other}")])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    found = dedup_lines(scratch, df).collect()
    assert len(found) == len(rows)
    by = lambda i: sorted((r["text"], [tuple(s) for s in r["removed"]]) for r in found if r["doc_id"] == i and r["text"] is not None)
    assert by(None) == [("", [(0, 0)])] * 5
    assert by(3) == [("", [(0, 1)])] * 2 + [(f"{line}\nshort", [])]
    assert by(4) == [("", [(0, 2)]), ("a\nb", [(1, 1)])]
    assert by(5) == [("few words", [])] * 4 and by(2) == [(other, [])] and len(by(7)) == 2
    df.coalesce(1).write.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["first"], s["last"])), ",")
    out = dedup_lines(scratch, df).select("doc_id", spans.alias("removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
    assert difference(out, con, OP2) is None
    df.unpersist()
