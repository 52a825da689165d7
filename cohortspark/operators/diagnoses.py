"""Diagnoses that first appear after the index date, rolled up to three-character codes and chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark import constants as k
from cohortspark.functions import if_else
from cohortspark.operators.relational import first_event
from cohortspark.sources import literal_table
from cohortspark.storage import shuffled

PAIR = ["person_id", "condition_concept_id"]


def classify(conditions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Conditions of the anchored persons, marked before, same or after the index date."""
    dates = anchors.select("person_id", "index_date").distinct()
    date, index = F.col("condition_start_date"), F.col("index_date")
    when = if_else(date < index, F.lit("before"), if_else(date > index, F.lit("after"), F.lit("same")))
    return (conditions.select(*PAIR, "condition_start_date").join(shuffled(dates), "person_id")
            .withColumn("condition", when))


def new_diagnoses(conditions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Pairs of person and condition seen after the index date and never before it.

    One aggregation decides each pair, so repeated diagnoses shrink before the shuffle.
    """
    seen = classify(conditions, anchors).groupBy(*PAIR).agg(
        F.bool_or(F.col("condition") == "after").alias("_after"),
        F.bool_or(F.col("condition") == "before").alias("_before"))
    return seen.filter(F.col("_after") & ~F.col("_before")).select(*PAIR)


def roll_up(pairs: DataFrame, relationship: DataFrame, concept: DataFrame, *, vocabulary: str = "ICD10CM",
            relation: str = "Mapped from") -> DataFrame:
    """Number of pairs per three-character code, with the code's name.

    A condition maps to the smallest related code. Pairs are counted per condition before they meet the vocabulary,
    so the joins work on one row per concept.
    """
    counts = pairs.groupBy("condition_concept_id").agg(F.count(F.lit(1)).alias("_pairs"))
    links = relationship.filter(F.col("relationship_id") == relation)
    codes = concept.filter(F.col("vocabulary_id") == vocabulary).select("concept_id", "concept_code")
    related = (counts.join(links, F.col("condition_concept_id") == F.col("concept_id_1"))
               .join(codes, F.col("concept_id_2") == F.col("concept_id")))
    mapped = first_event(related, "condition_concept_id", [F.col("concept_code").asc_nulls_last()])
    by_code = (mapped.groupBy(F.substring("concept_code", 1, 3).alias("ICD"))
               .agg(F.sum("_pairs").alias("n")))
    return (by_code.join(three_character_codes(concept, vocabulary), F.col("ICD") == F.col("concept_code"), "left")
            .select("ICD", "n", "concept_name"))


def count_codes(conditions: DataFrame, relationship: DataFrame, concept: DataFrame, *, vocabulary: str = "ICD10CM",
                relation: str = "Mapped from") -> DataFrame:
    """Conditions counted per related code of a vocabulary; they shrink to one row per concept before they meet it."""
    counts = conditions.groupBy("condition_concept_id").agg(F.count(F.lit(1)).alias("n"))
    links = relationship.filter(F.col("relationship_id") == relation)
    codes = concept.filter(F.col("vocabulary_id") == vocabulary).select("concept_id", "concept_code")
    return (counts.join(links, F.col("condition_concept_id") == F.col("concept_id_1"))
            .join(codes, F.col("concept_id_2") == F.col("concept_id"))
            .groupBy("concept_code").agg(F.sum("n").alias("n")))


def three_character_codes(concept: DataFrame, vocabulary: str = "ICD10CM") -> DataFrame:
    return (concept.filter((F.col("vocabulary_id") == vocabulary) & (F.length("concept_code") == 3))
            .select("concept_code", "concept_name"))


def chapter_titles(df: DataFrame) -> DataFrame:
    rows = [(number, f"{first}~{last}", title, korean) for number, first, last, title, korean in k.ICD_CHAPTERS]
    return literal_table(df.sparkSession, rows, "Chapter int, Block string, Title string, K_title string")


def chapter_of(code: Column, mode: str = "reference") -> Column:
    """Chapter number of a three-character code, NULL if none.

    ``reference`` goes by letter, with the numbers of D and H codes; ``blocks`` goes by the chapters' code ranges.
    """
    if mode == "blocks":
        rules = [(code.between(first, last), number) for number, first, last, *_ in k.ICD_CHAPTERS]
    elif mode == "reference":
        letter = F.substring(code, 1, 1)
        number_of = F.when(code.rlike("^.[0-9]{2}$"), F.substring(code, 2, 2).try_cast("int"))
        rules = [((letter == first) if low is None else (letter == first) & number_of.between(low, high), number)
                 for first, low, high, number in k.CHAPTER_LETTERS]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.coalesce(*[F.when(rule, F.lit(number)) for rule, number in rules])


def chapters(counts: DataFrame, *, mode: str = "reference") -> DataFrame:
    """Counts per chapter with the chapter's block and titles; codes without a chapter share a NULL row."""
    summed = counts.groupBy(chapter_of(F.col("ICD"), mode).alias("Chapter")).agg(F.sum("n").alias("n"))
    return summed.join(chapter_titles(counts), "Chapter", "left")
