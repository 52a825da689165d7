"""A corpus pipeline: language, exact copies, near copies, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every result as Parquet and reads it again as
the next stage's documents. All stages but the last return the columns of ``documents``, changed by their decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import exact, language, mixing, packing, simhash
from cohortspark.llm.tokens import ADDED
from cohortspark.storage import Scratch


_opened: list[Scratch] = []   # the tables that stages have written and that nobody has deleted


def _scratch(spark: SparkSession) -> Scratch:
    _opened.append(Scratch(spark))
    return _opened[-1]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; ``lang`` is the declared language and ``source`` the host. Texts without letters,
    and texts that no known language explains, go."""
    return language.keep_identified(_scratch(spark), docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text up to white space, the one with the smallest id."""
    return exact.exact_dedup(_scratch(spark), docs).filter("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by SimHash, the one with the smallest id."""
    return simhash.drop_near_duplicates(_scratch(spark), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document taken twice is two rows."""
    return mixing.mix(_scratch(spark), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their sequence and their place in it."""
    packed = packing.pack(_scratch(spark), docs, added=ADDED)
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id",
                         "offset")


STAGES = [("language ID", identify_language), ("exact dedup", drop_exact_copies), ("SimHash near-dedup", drop_near_copies),
          ("mixing sources to target weights", mix_sources), ("best-fit packing", pack_sequences)]

# SQL has neither the fingerprints' hash nor the tokenizer; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Once a stage's result is written, its own tables and the result before it are deleted."""
    scratch = Scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        earlier = len(_opened)
        result = stage(spark, docs, sf_dir)
        written = scratch.write(result, "stage")
        docs = scratch.read(written, result.schema)
        while len(_opened) > earlier:
            _opened.pop().close()
        if before:
            scratch.discard(before)
        before = written
    return docs
