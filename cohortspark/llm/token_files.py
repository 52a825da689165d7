"""Token counts of documents in flat, unindexed token files, by scanning for the end-of-document id."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.tokens import END_OF_TEXT, default_ranks, encoder
from cohortspark.storage import Scratch

BLOCKS = "file string, start long, data binary"


def write_tokens(df: DataFrame, text_col: str = "text", ranks: str | None = None, end: int = END_OF_TEXT,
                 dtype: str = "<u2", block_tokens: int = 1 << 18) -> DataFrame:
    """Flat token streams, one per task, as blocks (file, start, data): ids of all documents, each followed by ``end``.

    Blocks are cut every ``block_tokens`` ids wherever that falls; ``start`` is the place of a block's first id in its file.
    A null text is a document without ids. No order or index of documents is kept besides the stream itself.
    """
    path = ranks or default_ranks()

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = encoder(path), f"{TaskContext.get().partitionId():06d}"
        waiting, size, start = [], 0, 0

        def block(data: np.ndarray, at: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [file], "start": pa.array([at], pa.int64()), "data": [data.tobytes()]})

        for batch in batches:
            for text in batch.column(0):
                ids = encode(text.as_py() or "")
                ids.append(end)
                waiting.append(np.array(ids, dtype=dtype))
                size += len(ids)
                if size >= block_tokens:
                    stream = np.concatenate(waiting)
                    whole = len(stream) // block_tokens * block_tokens
                    for at in range(0, whole, block_tokens):
                        yield block(stream[at:at + block_tokens], start + at)
                    start, waiting, size = start + whole, [stream[whole:]], len(stream) - whole
        if size:
            yield block(np.concatenate(waiting), start)

    return df.select(F.col(f"`{text_col}`")).mapInArrow(emit, BLOCKS)


def read_files(spark: SparkSession, path: str, dtype: str = "<u2", block_tokens: int = 1 << 18) -> DataFrame:
    """Blocks (file, start, data) of raw token files that other programs have written. A file is at most 2 GB, as Spark reads
    binary files whole. A file whose last bytes make no id is torn and raises an error."""
    width = np.dtype(dtype).itemsize

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                data = content.as_buffer()
                if len(data) % width:
                    raise ValueError(f"{file.as_py()} is torn: {len(data)} bytes are no whole number of ids of {width} bytes")
                for at in range(0, len(data), block_tokens * width):
                    piece = data.slice(at, min(block_tokens * width, len(data) - at)).to_pybytes()
                    yield pa.RecordBatch.from_pydict({"file": [file.as_py()], "start": pa.array([at // width], pa.int64()),
                                                      "data": [piece]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, BLOCKS)


def count_tokens(scratch: Scratch, blocks: DataFrame, end: int = END_OF_TEXT, dtype: str = "<u2", span: int = 1024) -> DataFrame:
    """One row per document of each token file: (file, document, start, n_tokens, ended).

    Each block is searched for ``end`` with one vectorised comparison. Blocks are then stitched by a prefix scan of their
    summaries (place of the last separator, number of separators) in two levels: over ``span`` blocks of a file, and over
    the spans, so no task scans more than that many summaries of one file at the lower level. A document that goes on over
    any number of blocks is counted once, from the separator before it.

    ``document`` numbers the documents of a file from 0; ``start`` is the place of its first id; ``n_tokens`` leaves out the
    separator. Ids after the last separator of a file are a document with ``ended`` false. Adjacent separators enclose a
    document of 0 tokens. Null data is an empty block. Blocks need no order; extra columns are ignored. Blocks of a file
    must not overlap. An empty table gives an empty result.
    """
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(1).to_numpy(zero_copy_only=False)
            found, lengths = [], []
            for start, data in zip(starts, batch.column(2)):
                ids = np.frombuffer(data.as_buffer(), dtype) if data.is_valid else np.zeros(0, dtype)
                lengths.append(len(ids))
                found.append(np.flatnonzero(ids == end) + start)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["file", "start", "length", "ends"])

    scanned = scratch.cut(blocks.select("file", "start", "data").mapInArrow(find, "file string, start long, length long, ends array<long>"), "ends")
    # the summary of a block: separators, the place of the last one, the place after its last id
    blocks_ = scanned.select("file", "start", F.size("ends").cast("long").alias("n"), F.array_max("ends").alias("last"),
                             (F.col("start") + F.col("length")).alias("stop"))
    numbered = blocks_.withColumn("span", F.expr(f"start DIV {span * (1 << 18)}"))
    spans = numbered.groupBy("file", "span").agg(F.sum("n").alias("span_n"), F.max("last").alias("span_last"))
    over_spans = "OVER (PARTITION BY file ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    carried = spans.select("file", "span", F.expr(f"coalesce(sum(span_n) {over_spans}, 0)").alias("n_carried"),
                           F.expr(f"max(span_last) {over_spans}").alias("last_carried"))
    within = "OVER (PARTITION BY file, span ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    placed = (numbered.select("file", "span", "start", F.expr(f"coalesce(sum(n) {within}, 0)").alias("n_before"),
                              F.expr(f"max(last) {within}").alias("last_before"))
              .join(carried, ["file", "span"])
              .select("file", "start", (F.col("n_before") + F.col("n_carried")).alias("first_document"),
                      F.coalesce("last_before", "last_carried", F.lit(-1)).alias("before")))
    ended = (scanned.select("file", "start", "ends").filter(F.size("ends") > 0).join(placed, ["file", "start"])
             .select("file", "first_document", "before", F.posexplode("ends").alias("i", "at"), "ends")
             .select("file", (F.col("first_document") + F.col("i")).alias("document"),
                     (F.when(F.col("i") == 0, F.col("before")).otherwise(F.expr("get(ends, i - 1)")) + 1).alias("start"), "at")
             .select("file", "document", "start", (F.col("at") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended")))
    rest = (blocks_.groupBy("file").agg(F.sum("n").alias("document"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"),
                                        F.max("stop").alias("stop"))
            .filter("stop > start")
            .select("file", "document", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")))
    return ended.unionByName(rest)
