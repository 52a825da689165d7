"""Mixing sources to target weights: random order by hash, distributed prefix sums, and a cut at each source's budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.rows import WORD, prefix_sums, text_of
from cohortspark.storage import Scratch


def size_of(text: Column) -> Column:
    """Number of words; a missing text has none."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def key_of(id_column: Column, text: Column, seed: int) -> Column:
    """The random position of a document: equal rows have equal keys, so reruns agree."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_column.cast("string"), F.lit("")), text_of(text)))


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             columns: Sequence[str] = (), seed: int = 1) -> DataFrame:
    """``source``, ``size`` and ``key`` of each document, with the input columns asked for as one struct ``doc``."""
    named = {"id": F.col(f"`{id_col}`"), "text": F.col(f"`{text_col}`")}
    return df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc"), F.col(f"`{source_col}`").alias("source"),
                     size_of(named["text"]).alias("size"), key_of(named["id"], named["text"], seed).alias("key"))


def targets(scratch: Scratch, totals: DataFrame, weights: Sequence[int], share: float, epochs: int) -> DataFrame:
    """The word target of each source, from one row (source, source_size) per source.

    Sources in code-point order, null last, take the weights in turn. A target is ``weight * level`` and at most
    ``epochs * source_size``; the level makes all targets add up to ``share`` of all words. It equals resharing the excess by
    weight until no target is above its bound: with sources sorted by bound / weight, the level is the largest
    (budget - bounds of the earlier) / (weights of the rest) that the source itself can still reach.
    """
    cycle = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    ranked = prefix_sums(scratch, totals.select("source", "source_size", F.col("source").isNull().alias("last"), F.lit(1).cast("long").alias("one")),
                         ["last", "source"], ["one", "source_size"])
    weighed = scratch.cut(ranked.select(
        "source", "source_size", F.col("before_source_size").alias("source_start"), F.col("before_one").alias("rank"),
        F.element_at(cycle, (F.col("before_one") % len(weights) + 1).cast("int")).alias("weight"))
        .withColumn("bound", F.col("source_size") * epochs)
        .withColumn("ratio", F.col("bound").cast("double") / F.col("weight")), "weights")
    words, weight = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    ordered = prefix_sums(scratch, weighed.select("ratio", "rank", "bound", "weight"), ["ratio", "rank"], ["bound", "weight"])
    reach = (F.lit(share * (words or 0)) - F.col("before_bound")) / (F.lit(weight or 0) - F.col("before_weight"))
    level = ordered.select("ratio", reach.alias("level")).filter("level <= ratio").agg(F.max("level")).first()[0]
    return weighed.select("source", "source_size", "source_start",
                          F.least(F.col("weight") * F.lit(level or 0.0), F.col("bound").cast("double")).alias("target"))


def cuts(scratch: Scratch, sized: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5,
         epochs: int = 2) -> DataFrame:
    """One row per source: how many whole ``rounds`` each document is taken, and the key at which one more round is cut.

    Documents with the same key are summed first, so a row repeated a million times is one unit. Units are range-sorted by
    (source, key) and summed by distributed prefix sums, so a source with most rows spreads over many tasks.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    planned = scratch.cut(targets(scratch, totals, weights, share, epochs).withColumn(
        "budget", F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size") * epochs))
        .withColumn("rounds", F.when(F.col("source_size") > 0, F.expr("budget DIV source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("rounds") * F.col("source_size")), "targets")
    units = (sized.filter("size > 0").groupBy("source", "key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("copies"))
             .withColumn("last", F.col("source").isNull()))
    placed = prefix_sums(scratch, units, ["last", "source", "key"], ["words"])
    edge = (placed.withColumnRenamed("source", "of").join(planned.select("source", "source_start", "rest"), F.col("of").eqNullSafe(F.col("source")))
            .withColumn("start", F.col("before_words") - F.col("source_start"))
            .filter("start <= rest AND rest < start + words")
            .select("of", F.col("key").alias("cut_key"), F.expr("(rest - start) DIV copies").alias("cut_words")))
    return (planned.join(edge, F.col("of").eqNullSafe(F.col("source")), "left")
            .select("source", "source_size", "target", "rounds", "cut_key", "cut_words"))


def taken(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Add ``source_size``, ``target`` and ``taken`` (words the mix takes from the document, repeats counted)."""
    plan = plan.withColumnRenamed("source", "of")
    once_more = (F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.col("cut_words"))
                 .otherwise(F.lit(0)))
    return sized.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        *sized.columns, "source_size", "target", (F.col("rounds") * F.col("size") + once_more).alias("taken"))


def mix(scratch: Scratch, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[int] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 1) -> DataFrame:
    """The mixed corpus: rows of ``df``, repeated as often as the mix takes them.

    Each source gives its target (see ``targets``): whole rounds of all its documents, then one more round in the order of
    a hash of id and text, cut at the budget. The document at the cut gives its first words only; one key per source.
    Null text: empty, never taken. Null source: a source of its own, last in order. Rows equal in id and text share a key
    and, at the cut, its words evenly, rounded down. Documents without words are in no mix. Extra columns are carried along.
    """
    plan = cuts(scratch, scratch.cut(measured(df, id_col, text_col, source_col, seed=seed).drop("doc"), "sizes"), weights, share, epochs)
    rows = taken(measured(df, id_col, text_col, source_col, df.columns, seed), scratch.cut(plan, "cuts"))
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    each = rows.select("doc", "size", "taken", F.explode(F.sequence(F.lit(0), copies)).alias("n")).filter(F.col("n") < copies)
    left = F.col("taken") - F.col("n") * F.col("size")
    text = F.col(f"doc.`{text_col}`")
    words = F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), left.cast("int"))
    final = F.when(left >= F.col("size"), text).otherwise(F.array_join(words, ""))
    return each.select(*[final.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in df.columns])
