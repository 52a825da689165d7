"""Line dedup by winnowing: later copies of repeated runs of lines are deleted."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.rows import nested, row_key, text_of
from cohortspark.storage import Scratch


def windows(text: str | None, min_words: int) -> list[tuple[int, int, int, int, bytes]]:
    """(first line, last line, fingerprint, its line, content) of each shortest run of lines with at least ``min_words`` words.

    Both the shortest run from each line forwards and from each line backwards; the fingerprint is the smallest line hash in
    the run. Two copies of a run have the same windows inside, so every repeated run shares at least one fingerprint.
    """
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    ends = np.cumsum(np.fromiter((len(x.split()) for x in lines), np.int64, len(lines)))
    before = np.concatenate(([0], ends[:-1]))
    n = len(lines)
    last = np.searchsorted(ends, before + min_words)                # the first line that fills the run begun at each line
    first = np.searchsorted(before, ends - min_words, "right") - 1  # the last line that a run up to each line may begin at
    spans = {(i, int(j)) for i, j in enumerate(last) if j < n} | {(int(i), j) for j, i in enumerate(first) if i >= 0}
    if not spans:
        return []
    marks = [xxh3_64_intdigest(x, 7) - (1 << 63) for x in lines]
    out = []
    for i, j in sorted(spans):
        at = min(range(i, j + 1), key=marks.__getitem__)
        out.append((i, j, marks[at], at, xxh3_128_digest(b"\n".join(lines[i:j + 1]))))
    return out


def repeated_runs(scratch: Scratch, df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = 50) -> tuple[DataFrame, DataFrame]:
    """(key, spans) of the documents that hold later copies of repeated runs; spans are sorted (first, last) line numbers. And the
    keys of documents with enough words for a run that more than one row holds.

    A run of whole lines with at least ``min_words`` words that also stands earlier (in a document with a smaller id, or further
    up) is deleted. Steps: line hashes are winnowed to window minima; fingerprints that stand at one place only are dropped,
    with all windows around them; the other windows meet by content, and all but the first are later copies; copies that
    overlap or touch merge, which extends each match forwards and backwards to the whole repeated run.

    Position is (id, digest of the text, line), null ids last. Rows equal in id and text are one document here. A null text is
    one empty line. Hot lines: places and copies are reduced to their first one by aggregates that combine
    within tasks, and meet the windows in joins of one row against many, which adaptive execution can split.
    """
    key = row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for k, text in enumerate(batch.column(2)):
                found = windows(text.as_py(), min_words)
                rows += found
                keys += [k] * len(found)
            taken = pa.array(keys, pa.int64())
            place = pa.StructArray.from_arrays(
                [batch.column(0).is_null().take(taken), batch.column(0).take(taken), batch.column(1).take(taken),
                 pa.array([r[0] for r in rows], pa.int32())], names=["no_id", "id", "key", "line"])
            yield pa.RecordBatch.from_arrays(
                [place, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()),
                 pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.binary())],
                names=["place", "last", "mark", "mark_line", "content"])

    id_type = df.schema[id_col].dataType.simpleString()
    found = scratch.cut(df.select(F.col(f"`{id_col}`").alias("id"), key.alias("key"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        run, f"place struct<no_id:boolean,id:{id_type},key:binary,line:int>, last int, mark long, mark_line int, content binary"), "windows")
    # The shortest run from the first line stands once in each row of a document.
    heads = found.filter("place.line = 0").groupBy("place.key", "last").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    stand = F.struct("place.key", "mark_line")
    # Summaries are written before they are joined: the joins then read plain shuffles, in which a hot line can be split.
    marks = scratch.cut(found.groupBy("mark").agg(F.min(stand).alias("a"), F.max(stand).alias("b")).filter("a < b").select("mark"), "marks")
    likely = scratch.cut(found.join(marks, "mark", "left_semi").select("place", "last", "content"), "likely")
    first = scratch.cut(likely.groupBy("content").agg(F.min("place").alias("first"), F.max("place").alias("final"))
                        .filter("first < final").select(F.col("content").alias("of"), "first"), "first")
    later = likely.join(first, F.col("content") == F.col("of")).filter("place > first").select("place.key", "place.line", "last").distinct()
    starts = F.expr("max(last) OVER (PARTITION BY key ORDER BY line, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    runs = later.withColumn("fresh", (F.coalesce(starts, F.lit(-2)) + 1 < F.col("line")).cast("int"))
    runs = runs.withColumn("run", F.expr("sum(fresh) OVER (PARTITION BY key ORDER BY line, last)"))
    merged = runs.groupBy("key", "run").agg(F.min("line").alias("first"), F.max("last").alias("last"))
    return merged.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")), heads.select("key").distinct()


def dedup_lines(scratch: Scratch, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """The rows of ``df`` with later copies of repeated runs cut out of the text, and the cut ``removed`` line spans.

    See ``repeated_runs``. Lines end at a newline; what is left is joined by newlines again. A text without repeats, null
    texts included, stays as it is, with an empty ``removed``. No row is dropped, even if its text becomes empty. Of rows equal
    in id and text one fares as if it were alone; in the others all is a later copy, so a text of at least ``min_words`` words
    is cut as a whole. Such rows are written once, and chosen by an aggregate, so that a great number of them can be split.
    """
    runs, repeated = repeated_runs(scratch, df, id_col, text_col, min_words)
    spans, repeated = scratch.cut(runs, "runs"), scratch.cut(repeated, "repeated")
    docs = df.select(nested(df).alias("doc"), row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("key"))
    text = F.col(f"doc.`{text_col}`")
    gone = None
    if not repeated.isEmpty():
        copies = scratch.cut(docs.join(repeated, "key", "left_semi").withColumn("row", F.monotonically_increasing_id()), "copies")
        first = scratch.cut(copies.groupBy("key").agg(F.min("row").alias("row")), "first-copies")
        gone = copies.join(first.withColumnRenamed("row", "kept"), "key").filter("row <> kept").select(
            "doc", "key", F.lit("").alias("cleaned"),
            F.array(F.struct(F.lit(0).alias("first"), (F.size(F.split(text_of(text), "\n")) - 1).alias("last"))).alias("removed"))
        docs = docs.join(repeated, "key", "left_anti").unionByName(copies.join(first, ["key", "row"], "left_semi").drop("row"))
    left = F.filter(F.split(text_of(text), "\n"), lambda _, i: ~F.exists("spans", lambda s: (s["first"] <= i) & (i <= s["last"])))
    # The spans grow with the corpus: texts and spans are shuffled to each other at every size, never broadcast.
    cleaned = (docs.join(spans.hint("merge"), "key", "left")
               .withColumn("cleaned", F.when(F.col("spans").isNull(), text).otherwise(F.array_join(left, "\n")))
               .withColumn("removed", F.coalesce("spans", F.expr("CAST(array() AS array<struct<first:int,last:int>>)"))).drop("spans"))
    if gone is not None:
        cleaned = cleaned.unionByName(gone)
    return cleaned.select(*[F.col("cleaned").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c)
                            for c in df.columns if c.lower() != "removed"], "removed")
