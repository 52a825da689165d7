"""The supplied sales tables, relabelled as clinical tables and code lists.

Plain projections of customer, orders and lineitem; the numbers test the code and say nothing medical. Some genders,
birth months, condition dates and recorded ends of exposures are missing or impossible, recorded ends differ from the
supply's, and some exposures last over a year, so that rules which differ only there give different results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark import constants as k
from cohortspark.sources import ClinicalTables, CodeLists
from cohortspark.storage import shuffled

# The classes of the covariate drugs, by (concept id * 7) % 19.
CLASS_CYCLE = (*k.DRUG_CLASSES, "other")


def clinical_tables(spark: SparkSession, folder: str) -> ClinicalTables:
    customer, orders, lineitem = (spark.read.parquet(f"{folder}/{t}.parquet")
                                  for t in ("customer", "orders", "lineitem"))
    shipped = lineitem.join(shuffled(orders), F.col("l_orderkey") == F.col("o_orderkey"))
    return ClinicalTables(
        person=customer.selectExpr(
            "c_custkey AS person_id",
            "CAST(CASE WHEN c_custkey % 53 = 0 THEN NULL WHEN c_custkey % 6 < 3 THEN 8507 ELSE 8532 END AS BIGINT) AS gender_concept_id",
            "CAST(1930 + (c_custkey * 7) % 70 AS INT) AS year_of_birth",
            "CAST(CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 89 = 0 THEN 13 ELSE 1 + c_custkey % 12 END AS INT) "
            "AS month_of_birth",
            "CAST(1 + c_custkey % 28 AS INT) AS day_of_birth"),
        measurement=_measurement(orders),
        drug_exposure=shipped.selectExpr(
            "l_orderkey * 10 + l_linenumber AS drug_exposure_id", "o_custkey AS person_id",
            "l_partkey % 200 AS drug_concept_id", "CAST(l_shipdate AS DATE) AS drug_exposure_start_date",
            "CASE WHEN l_orderkey % 37 = 0 THEN NULL WHEN l_orderkey % 41 = 0 OR l_partkey % 200 = 5 "
            "AND l_orderkey % 3 = 0 THEN date_add(CAST(l_shipdate AS DATE), 700) "
            "ELSE date_add(CAST(l_shipdate AS DATE), CAST(l_quantity + l_orderkey % 5 AS INT) - 1) END AS drug_exposure_end_date",
            "CAST(l_quantity AS INT) AS days_supply"),
        condition_occurrence=shipped.selectExpr(
            "o_custkey AS person_id", "(l_orderkey * 31 + l_linenumber * 17) % 200 AS condition_concept_id",
            "CASE WHEN l_orderkey % 43 <> 0 THEN CAST(l_shipdate AS DATE) END AS condition_start_date"),
        procedure_occurrence=shipped.selectExpr(
            "o_custkey AS person_id",
            "CASE WHEN l_orderkey % 101 = 0 THEN 4036252 ELSE 10000 + l_suppkey END AS procedure_concept_id",
            "CAST(l_shipdate AS DATE) AS procedure_date",
            "CASE WHEN l_orderkey % 89 = 0 THEN concat('KP455', CAST(1 + l_orderkey % 4 AS STRING), '0') "
            "ELSE concat('M', CAST(l_orderkey % 1000 AS STRING)) END AS procedure_source_value"),
        concept_relationship=_relationship(spark),
        concept=_concept(spark))


def _measurement(orders: DataFrame) -> DataFrame:
    return (orders.selectExpr("*", "(o_orderkey * 7919 + 104729) % 1000 AS u")
            .selectExpr("*", "CASE WHEN u < 30 THEN 460 + u * 10 WHEN u < 40 THEN u - 20 "
                             "ELSE 50 + (u * 13) % 400 END AS q")
            .selectExpr(
                "o_orderkey AS measurement_id", "o_custkey AS person_id",
                "CAST(CASE WHEN o_orderkey % 10 < 6 THEN 1001 + o_orderkey % 2 WHEN o_orderkey % 10 < 8 THEN 3010340 "
                "WHEN o_orderkey % 10 = 8 THEN 3016451 ELSE 3008486 END AS BIGINT) AS measurement_concept_id",
                "CAST(o_orderdate AS DATE) AS measurement_date",
                "CASE WHEN u = 999 THEN '<0.01' WHEN u = 998 THEN NULL "
                "ELSE concat(CAST(q / 100.0 AS DECIMAL(20, 2)), ' uIU/mL') END AS value_source_value"))


def _relationship(spark: SparkSession) -> DataFrame:
    return spark.range(600).selectExpr(
        "id div 3 AS concept_id_1", "500000 + (id div 3) * 10 + id % 3 AS concept_id_2",
        "CASE WHEN id % 3 < 2 THEN 'Mapped from' ELSE 'Maps to' END AS relationship_id")


def _concept(spark: SparkSession) -> DataFrame:
    diagnoses = spark.range(600).selectExpr("id div 3 AS c", "id % 3 AS j").selectExpr(
        "500000 + c * 10 + j AS concept_id", "concat('dx ', c, '/', j) AS concept_name", "'Condition' AS domain_id",
        "CASE WHEN j < 2 THEN 'ICD10CM' ELSE 'SNOMED' END AS vocabulary_id", "'billing' AS concept_class_id",
        "concat(chr(65 + (c * 5 + j) % 26), lpad(CAST((c * 7) % 100 AS STRING), 2, '0'), '.', j) AS concept_code")
    blocks = spark.range(2600).selectExpr("id div 100 AS l", "id % 100 AS n").selectExpr(
        "600000 + l * 100 + n AS concept_id", "concat('block ', l, '-', n) AS concept_name",
        "'Condition' AS domain_id", "'ICD10CM' AS vocabulary_id", "'3-char' AS concept_class_id",
        "concat(chr(65 + l), lpad(CAST(n AS STRING), 2, '0')) AS concept_code")
    return diagnoses.unionByName(blocks)


def code_lists(spark: SparkSession) -> CodeLists:
    ids = spark.range(200).withColumnRenamed("id", "concept_id")
    concept = F.col("concept_id")
    classes = F.element_at(F.array(*[F.lit(c) for c in CLASS_CYCLE]), (concept * 7 % 19 + 1).cast("int"))
    flags = [F.when(concept % 23 == j - 1, F.lit(1)).when((concept + j) % 5 == 0, F.lit(None).cast("int"))
             .otherwise(F.lit(0)).alias(name) for j, name in enumerate(k.COMORBIDITIES, start=1)]
    return CodeLists(
        lab=spark.range(1001, 1003).withColumnRenamed("id", "concept_id"),
        target_drug=ids.filter((concept % 20 < 4) & (concept != 5)),
        excluded_condition=ids.filter(concept == 3),
        excluded_drug=ids.filter(concept == 5),
        covariate_drug=ids.filter((concept % 20 >= 4) & (concept != 5)).withColumn("drname", classes),
        covariate_condition=ids.filter(concept % 29 == 4)
                               .withColumn("dis1", F.when(concept % 3 != 0, F.lit(1))),
        comorbidity=ids.filter(concept % 23 < 17).select("concept_id", *flags))
