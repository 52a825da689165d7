"""Code lists. Spark broadcasts them by their measured size; larger ones are shuffled instead."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.constants import COMORBIDITIES

# Columns of the code lists that carry more than the concept id.
COVARIATE_DRUG_SCHEMA = "concept_id bigint, drname string"
COVARIATE_CONDITION_SCHEMA = "concept_id bigint, dis1 int"
COMORBIDITY_SCHEMA = "concept_id bigint, " + ", ".join(f"{c} int" for c in COMORBIDITIES)


@dataclass(frozen=True)
class CodeLists:
    """The code lists of a study."""

    lab: DataFrame
    target_drug: DataFrame
    excluded_condition: DataFrame
    excluded_drug: DataFrame
    covariate_drug: DataFrame
    covariate_condition: DataFrame
    comorbidity: DataFrame

    @classmethod
    def from_csv(cls, spark: SparkSession, **paths: str) -> CodeLists:
        """Read each list from the CSV file given under its field name."""
        schemas = {"covariate_drug": COVARIATE_DRUG_SCHEMA, "covariate_condition": COVARIATE_CONDITION_SCHEMA,
                   "comorbidity": COMORBIDITY_SCHEMA}
        return cls(**{name: csv_codes(spark, path, schemas.get(name, "concept_id bigint"))
                      for name, path in paths.items()})


def csv_codes(spark: SparkSession, path: str, schema: str = "concept_id bigint") -> DataFrame:
    """A code list from a CSV file: the columns of the schema, found by their names in the header, in any order.

    Other columns are left out; a missing one raises an error, and so does a value that cannot be read as its type, as the
    cohort would change without a word. NA, an empty field and blanks are missing values.
    """
    header = spark.read.csv(path, header=True, nullValue="NA")   # all columns as text; Spark reads the first line only
    wanted = [part.split() for part in schema.split(",")]
    missing = [name for name, _ in wanted if name not in header.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    texts = {name: F.trim(F.col(f"`{name}`")) for name, _ in wanted}
    bad = {name: texts[name].isNotNull() & (texts[name] != "") & texts[name].try_cast(kind).isNull() for name, kind in wanted}
    counted = header.agg(*[F.struct(F.count_if(b), F.min(F.when(b, texts[name]))).alias(name) for name, b in bad.items()]).first()
    unread = [f"{counted[name][0]} lines with an unreadable {name} such as {counted[name][1]!r}" for name in bad if counted[name][0]]
    if unread:
        raise ValueError(f"{path} has {' and '.join(unread)}")
    return header.select(*[texts[name].try_cast(kind).alias(name) for name, kind in wanted])


def literal_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A constant table as an expression, so that its small size is known to the optimizer."""
    names_types = [part.split() for part in schema.split(",")]
    structs = [F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, names_types)])
               for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def literal_codes(spark: SparkSession, codes: Iterable[int]) -> DataFrame:
    """A code list from literal ids."""
    return literal_table(spark, [(code,) for code in codes], "concept_id bigint")


def listed_events(events: DataFrame, column: str, codes: DataFrame, most: int = 1000) -> DataFrame:
    """The same rows as ``in_codes``, with the scan pruned by short lists.

    The list is measured: up to ``most`` different codes become an in-list, which reaches the scan and skips Parquet row groups
    (by each code, or for longer lists by their range) and slices of a database. A longer list is joined; its smallest and
    largest code still reach the scan. The result does not depend on it.
    """
    given = codes.select(codes["concept_id"].alias("code")).filter("code IS NOT NULL")
    known = given.distinct().limit(most + 1).collect()
    if len(known) > most:
        low, high = given.agg(F.min("code"), F.max("code")).first()
        return in_codes(events.filter(F.col(column).between(low, high)), column, codes).select(*events.columns)
    kind = events.schema[column].dataType   # a code that the column cannot hold is in no row
    return events.filter(F.col(column).isin(*[F.lit(r["code"]).try_cast(kind) for r in known]) if known else F.lit(False))


def in_codes(events: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Events whose concept is on the list. Equality join, so a NULL concept never matches."""
    keys = codes.select(codes["concept_id"].alias(column))
    return events.join(keys, column, "left_semi")
