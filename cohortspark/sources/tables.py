"""The clinical tables a study reads, from parquet, a catalog or a database."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.storage import Scratch, shuffled


@dataclass(frozen=True)
class ClinicalTables:
    """Lazy tables of the common data model; only the columns a plan names are read."""

    person: DataFrame
    measurement: DataFrame
    drug_exposure: DataFrame
    condition_occurrence: DataFrame
    procedure_occurrence: DataFrame
    concept_relationship: DataFrame
    concept: DataFrame

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, vocabulary: str | None = None) -> ClinicalTables:
        return cls(**{name: spark.read.parquet(f"{place}/{name}.parquet")
                      for name, place in _places(cls, folder, vocabulary)})

    @classmethod
    def from_catalog(cls, spark: SparkSession, schema: str, vocabulary: str | None = None) -> ClinicalTables:
        return cls(**{name: spark.table(f"{place}.{name}") for name, place in _places(cls, schema, vocabulary)})

    @classmethod
    def from_jdbc(cls, spark: SparkSession, url: str, schema: str, vocabulary: str | None = None, *,
                  person_ids: tuple[int, int], partitions: int, **options: str) -> ClinicalTables:
        """Read over JDBC, event tables in ``partitions`` slices of the person id range."""
        low, high = person_ids

        def table(name: str, place: str) -> DataFrame:
            reader = spark.read.format("jdbc").options(url=url, dbtable=f"{place}.{name}", **options)
            if not name.startswith("concept"):
                reader = reader.options(partitionColumn="person_id", lowerBound=low, upperBound=high,
                                        numPartitions=partitions)
            return reader.load()
        return cls(**{name: table(name, place) for name, place in _places(cls, schema, vocabulary)})


    def by_person(self, scratch: Scratch) -> ClinicalTables:
        """The same tables with persons and events written anew, laid out by person, so that the screening needs no exchange of
        them. Worth it for tables that several studies read."""
        return ClinicalTables(**{f.name: getattr(self, f.name) if f.name.startswith("concept")
                                 else scratch.cut_by(getattr(self, f.name), f.name, "person_id") for f in fields(self)})


def _places(cls: type, schema: str, vocabulary: str | None) -> list[tuple[str, str]]:
    return [(f.name, (vocabulary or schema) if f.name.startswith("concept") else schema) for f in fields(cls)]


def of_persons(events: DataFrame, persons: DataFrame, key: str = "person_id") -> DataFrame:
    """Events of the given persons, as a join: the ids never pass through the driver."""
    return events.join(shuffled(persons.select(key).distinct()), key, "left_semi")


def dynamic_codes(events: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Events whose column, named at run time, holds one of the codes; both sides compare as text."""
    keys = codes.select(F.col("concept_id").cast("string").alias("_code"))
    return events.join(keys, F.col(column).cast("string") == F.col("_code"), "left_semi")


def contains_any(column: str | Column, patterns: Iterable[str]) -> Column:
    """Whether the text holds one of the patterns anywhere."""
    text = F.col(column) if isinstance(column, str) else column
    return reduce(lambda a, b: a | b, [text.contains(p) for p in patterns])
