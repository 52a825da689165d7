from __future__ import annotations

import hashlib
import re
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import functions as F

from cohortspark.llm.exact import exact_dedup

LONG = "word " * 60_000
ROWS = [(5, "a  b"), (3, "a b"), (4, "a\n\tb"), (9, None), (8, ""), (7, " "), (None, "a b"), (1, "unique"), (2, LONG), (6, LONG),
        (None, "only nulls"), (None, "only nulls"), (11, "twin"), (11, "twin"), (12, "A b"), (13, " a b")]


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str), len(groups)


def test_groups_match_brute_force(scratch, docs_of):
    expected, groups = brute(ROWS)
    for bits in (16, 1):   # a crowded filter sends more rows the grouped way, with the same result
        rows = exact_dedup(scratch, docs_of(ROWS), bits_per_row=bits, max_bits=1 << 15).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str) == expected
        kept = [r for r in rows if r["kept"]]
        assert len(kept) == groups and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_full_filter_changes_nothing(scratch, docs_of):
    rows = [(i, f"text {i % 700}") for i in range(2000)]
    sizes = [{(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup(scratch, docs_of(rows), bits_per_row=b).collect()} for b in (1, 64)]
    assert sizes[0] == sizes[1] and sum(k for _, _, k in sizes[0]) == 700


def grouped_rows(scratch, spark, rows, **sizes):
    """What comes back, and how many rows went the grouped way."""
    df = spark.range(rows, numPartitions=13).selectExpr("id AS doc_id", "CONCAT('text ', IF(id % 50 = 0, id DIV 500, -id)) AS text")
    out = exact_dedup(scratch, df, columns=["doc_id"], **sizes).collect()
    folder = max(Path(unquote(urlparse(scratch.root).path)).glob("*-maybe"))
    return out, spark.read.parquet(str(folder)).count()


def test_a_filter_beyond_the_broadcast_keeps_its_share(scratch, spark):
    shares = []
    for rows in (4_000, 40_000, 120_000):   # the largest one has several slabs
        out, grouped = grouped_rows(scratch, spark, rows, max_bits=1 << 15)
        plain, as_broadcast = grouped_rows(scratch, spark, rows)
        assert sorted(out) == sorted(plain) and grouped == as_broadcast and len(out) == rows
        assert sum(r["kept"] for r in out) == rows - rows // 50 + rows // 500
        shares.append(grouped / rows)
    assert max(shares) < 0.08 and max(shares) - min(shares) < 0.04


def test_clashing_columns_and_empty_table(scratch, docs_of):
    df = docs_of(ROWS).withColumn("Kept", F.lit("x")).withColumn("segment", F.lit(1)).withColumn("id", F.lit(2)).withColumn("bits", F.lit(3))
    out = exact_dedup(scratch, df)
    assert out.columns == [*docs_of([]).columns, "segment", "id", "bits", "keep_id", "group_size", "kept", "text_sha256"]
    assert out.count() == len(ROWS)
    assert exact_dedup(scratch, docs_of([])).count() == 0


def test_plan_is_native_and_unique_rows_do_not_shuffle(scratch, docs_of):
    out = exact_dedup(scratch, docs_of([(i, f"t{i}") for i in range(100)]))
    large = exact_dedup(scratch, docs_of([(i, f"t{i}") for i in range(40_000)]), max_bits=1 << 15)
    for df in (out, large):
        plan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "Window"))
        assert all(keys.startswith("text_sha256") for keys in re.findall(r"hashpartitioning\((\w+)", plan))
