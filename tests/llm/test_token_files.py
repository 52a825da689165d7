from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import token_files, tokens

BLOCKS = "file string, start long, data binary"


def brute(ids, end):
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == end:
            out.append((len(out), start, i - start, True))
            start = i + 1
    if start < len(ids):
        out.append((len(out), start, len(ids) - start, False))
    return out


@pytest.mark.parametrize("block", [1, 3, 64, 1000])
def test_stitching_across_blocks(spark, scratch, block):
    r = random.Random(block)
    rows, expected = [], []
    for f in range(7):
        ids = [r.choice([9, 9, 9, 1, 2, 3]) if f < 3 else r.randint(1, 400) for _ in range(r.choice([0, 1, 500, 900]))]
        expected += [(f"f{f}", *d) for d in brute(ids, 9)]
        rows += [(f"f{f}", at, np.array(ids[at:at + block], "<u2").tobytes()) for at in range(0, len(ids), block)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, BLOCKS).withColumn("document", F.lit("x"))
    for span in (1, 1024):
        found = token_files.count_tokens(scratch, df, end=9, span=span)
        assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_null_data_and_no_blocks(spark, scratch):
    df = spark.createDataFrame([("a", 0, None)], BLOCKS)
    assert token_files.count_tokens(scratch, df).count() == 0
    assert token_files.count_tokens(scratch, df.limit(0)).count() == 0


def test_documents_are_counted_as_encoded(scratch, docs_of):
    texts = ["", None, "a b", "a b", "<|endoftext|>", "word " * 30_000] + [f"text {i} " * i for i in range(200)]
    df = docs_of(list(enumerate(texts)))
    encode = tokens.encoder(tokens.default_ranks())
    for block in (100, 1 << 18):
        files = scratch.cut(token_files.write_tokens(df.repartition(3), block_tokens=block), "tokens")
        found = token_files.count_tokens(scratch, files).collect()
        assert all(r["ended"] for r in found)
        assert sorted(r["n_tokens"] for r in found) == sorted(len(encode(t or "")) for t in texts)


def test_raw_files(spark, scratch, tmp_path):
    ids = [5, 6, 9, 9, 7]
    for k in range(3):
        np.array(ids * (k + 1), "<u2").tofile(tmp_path / f"part-{k}.bin")
    (tmp_path / "part-3.bin").write_bytes(b"")
    blocks = token_files.read_files(spark, str(tmp_path), block_tokens=4)
    found = token_files.count_tokens(scratch, blocks, end=9).collect()
    assert len(found) == sum(len(brute(ids * (k + 1), 9)) for k in range(3))


def test_torn_files_are_refused(spark, tmp_path):
    (tmp_path / "part-0.bin").write_bytes(b"\x01\x00\x02")
    with pytest.raises(Exception, match="part-0.bin is torn: 3 bytes"):
        token_files.read_files(spark, str(tmp_path)).count()
