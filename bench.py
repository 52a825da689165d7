"""Time the headline stages cold, each on the written result of the stage before; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from checks.binding import clinical_tables, code_lists
from cohortspark.operators import matching
from cohortspark.plans.study import Study
from cohortspark.storage import Scratch

STAGES = ("labs", "screened", "cases", "matches", "attrition", "case_control", "analysis", "frequencies", "crude_odds",
          "adjusted_odds", "near_eras", "lab_summary", "hormone_series", "new_codes", "new_chapters")


def crowded(spark: SparkSession, cases: int = 8000) -> float:
    """Matching when all cases together need every control: long chains of displaced cases. Not part of the total."""
    def people(first: int, n: int, salt: int):
        return spark.range(first, first + n).selectExpr(
            "id AS person_id", "1L AS gender_concept_id", f"CAST(40 + pmod(xxhash64(id, {salt}), 8) AS INT) AS age",
            f"date_add(DATE'2010-01-01', CAST(pmod(xxhash64(id, {salt + 1}), 40) AS INT)) AS enroll_date")
    scratch = Scratch(spark)
    begin = time.perf_counter()
    pairs = matching.match_controls(people(1, cases, 9).withColumn("case_number", F.col("person_id")), people(1_000_000, 4 * cases, 5), scratch)
    pairs.write.format("noop").mode("overwrite").save()
    scratch.close()
    return round(time.perf_counter() - begin, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()   # start the JVM's workers outside the clock
    study = Study(spark, clinical_tables(spark, folder), code_lists(spark))
    times = {}
    for stage in STAGES:
        begin = time.perf_counter()
        getattr(study, stage).write.format("noop").mode("overwrite").save()
        times[stage] = round(time.perf_counter() - begin, 3)
    print(json.dumps({"metric": "total_stage_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                      "crowded_matches": crowded(spark)}))
    spark.stop()


if __name__ == "__main__":
    main()
