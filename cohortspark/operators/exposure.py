"""Drug exposure before an index date, continuous use and drug eras."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortspark import constants as k
from cohortspark.functions import exposure_end, na_agg, within_days
from cohortspark.operators.intervals import dates_in_windows, spans_in_windows
from cohortspark.storage import shuffled


def with_exposure_end(drugs: DataFrame) -> DataFrame:
    """Exposures with the last day their supply covers."""
    return drugs.withColumn("drug_end_date", exposure_end(F.col("drug_exposure_start_date"), F.col("days_supply")))


def exposures_before(anchors: DataFrame, drugs: DataFrame, *, days: int = k.LOOKBACK_DAYS,
                     mode: str = "endpoint") -> DataFrame:
    """Anchor rows joined to the exposures in the look-back window; ``anchors`` has person, case and indexdt2."""
    ended = with_exposure_end(drugs)
    start, end = "drug_exposure_start_date", "drug_end_date"
    window = F.date_sub("indexdt2", days), F.date_sub("indexdt2", 1)
    if mode == "endpoint":
        return dates_in_windows(anchors, ended, [start, end], *window, width=days)
    if mode == "overlap":
        return spans_in_windows(anchors, ended, start, F.coalesce(end, start), *window, width=days)
    raise ValueError(f"unknown mode {mode!r}")


def exposure_window(anchors: DataFrame, drugs: DataFrame, *, days: int = k.LOOKBACK_DAYS,
                    mode: str = "endpoint", clip: bool = True) -> DataFrame:
    """Distinct exposures in the look-back window, clipped to it; a missing end stays missing."""
    rows = (exposures_before(anchors.select("person_id", "case_number", "indexdt2"), drugs, days=days, mode=mode)
            .select("person_id", "case_number", "indexdt2", "drug_exposure_start_date", "drug_end_date", "days_supply")
            .distinct())
    start, end = F.col("drug_exposure_start_date"), F.col("drug_end_date")
    first, last = F.date_sub("indexdt2", days), F.date_sub("indexdt2", 1)
    if not clip:
        first, last = start, end
    return rows.withColumns({"drug_exposure_start_date2": F.when(start < first, first).otherwise(start),
                             "drug_end_date2": F.when(end > last, last).otherwise(end)})


def recency_class(exposures: DataFrame, *, bins: Sequence[int] = k.RECENCY_BINS) -> DataFrame:
    """Exposed flag and the most recent bin that a clipped start or end falls in, per person and case."""
    recency = F.lit(None).cast("int")
    for number, (near, far) in reversed(list(enumerate(zip((0, *bins), bins), start=1))):
        touched = [within_days(F.col(c), F.col("indexdt2"), -far, -near - 1)
                   for c in ("drug_exposure_start_date2", "drug_end_date2")]
        recency = F.when(touched[0] | touched[1], F.lit(number)).otherwise(recency)
    return (exposures.withColumn("_w", recency).groupBy("person_id", "case_number")
            .agg(F.lit(1).alias("allo"), na_agg(F.min, "_w").alias("w")))


def exposure_gaps(exposures: DataFrame) -> DataFrame:
    """Days from the previous row's clipped start to this row's clipped end, in start order.

    Exposures are distinct and lie in one look-back window, so a group has a bounded number of rows.
    """
    order = (Window.partitionBy("person_id", "case_number")
             .orderBy(F.col("drug_exposure_start_date2").asc_nulls_last(), F.col("drug_end_date2").asc_nulls_last()))
    return exposures.withColumn("cwc", F.datediff("drug_end_date2", F.lag("drug_exposure_start_date2").over(order)))


def continuous_use(exposures: DataFrame, *, gap: int = k.SPAN_GAP) -> DataFrame:
    """Days of the first unbroken span of use; a row breaks it when it ends over ``gap`` days after the previous
    row's start."""
    order = (Window.partitionBy("person_id", "case_number")
             .orderBy(F.col("drug_exposure_start_date2").asc_nulls_last(), F.col("drug_end_date2").asc_nulls_last())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    breaks = F.coalesce(F.col("cwc") > gap, F.lit(False)).cast("int")
    return (exposure_gaps(exposures).withColumn("_breaks", F.sum(breaks).over(order)).filter("_breaks = 0")
            .groupBy("person_id", "case_number")
            .agg((F.datediff(na_agg(F.max, "drug_end_date2"), na_agg(F.min, "drug_exposure_start_date2")) + 1)
                 .alias("drugday")))


def drug_eras(drugs: DataFrame, *, gap: int = k.ERA_GAP, compare: str = "previous_row") -> DataFrame:
    """Eras of use per person: a new one begins over ``gap`` days after the previous end, or when that is missing.

    ``previous_row`` compares with the end of the row before, ``running_max`` with the latest end so far. Rows
    shrink to distinct (start, end) pairs with a count before the shuffle, so a person's group is bounded by the
    calendar however many rows it has.
    """
    pairs = (drugs.groupBy("person_id", F.col("drug_exposure_start_date").alias("_start"),
                           F.col("drug_exposure_end_date").alias("_end"))
             .agg(F.count(F.lit(1)).alias("_copies")))
    order = Window.partitionBy("person_id").orderBy(F.col("_start").asc_nulls_last(), F.col("_end").asc_nulls_last())
    if compare == "previous_row":
        previous = F.lag("_end").over(order)
    elif compare == "running_max":
        previous = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    else:
        raise ValueError(f"unknown comparison {compare!r}")

    def opens(end: str) -> Column:
        return (~F.coalesce(F.col("_start") <= F.date_add(F.col(end), gap), F.lit(False))).cast("bigint")

    # Copies of a row with a missing or inverted end open an era each, as they would one after the other.
    own_end = "_end" if compare == "previous_row" else "_latest"
    rows = pairs.withColumns({"_previous": previous, "_latest": F.greatest(previous, F.col("_end"))})
    rows = rows.withColumns({"_opens": opens("_previous"), "_more": (F.col("_copies") - 1) * opens(own_end)})
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.withColumn("_last", F.sum(F.col("_opens") + F.col("_more")).over(running))
            .withColumn("era", F.explode(F.sequence(F.col("_last") - F.col("_more"), F.col("_last"))))
            .groupBy("person_id", "era")
            .agg(na_agg(F.min, "_start").alias("start_date"), na_agg(F.max, "_end").alias("last_intake"))
            .withColumn("drug_days", F.datediff("last_intake", "start_date")))


def scanned_eras(drugs: DataFrame, *, gap: int = k.ERA_GAP, compare: str = "previous_row", block_days: int = 366) -> DataFrame:
    """The eras of ``drug_eras`` by a scan in two levels, for persons whose rows should not meet in one task.

    A person's rows are cut into blocks by the day they start on. Each block is summed up in one row: the end of its last
    row, its latest end and, once the block before is known, the number of eras that it opens. The summaries combine
    associatively along the person's blocks, and what comes out before a block is handed to its rows. Windows see the rows of
    one block, or the blocks of one person.
    """
    if compare not in ("previous_row", "running_max"):
        raise ValueError(f"unknown comparison {compare!r}")
    pairs = (drugs.groupBy("person_id", F.col("drug_exposure_start_date").alias("_start"),
                           F.col("drug_exposure_end_date").alias("_end"))
             .agg(F.count(F.lit(1)).alias("_copies")))
    # Rows without a start come last.
    block = F.coalesce(F.floor(F.unix_date("_start") / F.lit(block_days)), F.lit((1 << 31) - 1)).cast("int")
    part = ["person_id", "_block"]
    order = Window.partitionBy(*part).orderBy(F.col("_start").asc_nulls_last(), F.col("_end").asc_nulls_last())
    blocks = Window.partitionBy("person_id").orderBy("_block")
    earlier_rows, earlier_blocks = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (order, blocks))
    rows = pairs.withColumn("_block", block).withColumns({
        "_row": F.row_number().over(order), "_lag": F.lag("_end").over(order), "_top": F.max("_end").over(earlier_rows)})

    def handed(summaries: DataFrame, *columns: Column) -> DataFrame:
        """What the blocks before each block come to, joined to the rows of the block."""
        return summaries.select(F.col("person_id").alias("_person"), F.col("_block").alias("_of"), *columns)

    def with_handed(to: DataFrame, what: DataFrame) -> DataFrame:
        same = F.col("person_id").eqNullSafe(F.col("_person")) & (F.col("_block") == F.col("_of"))
        return to.join(shuffled(what), same).drop("_person", "_of")

    ends = rows.groupBy(*part).agg(F.max_by("_end", "_row").alias("_last_end"), F.max("_end").alias("_latest_end"))
    rows = with_handed(rows, handed(ends, F.lag("_last_end").over(blocks).alias("_end_before"),
                                    F.max("_latest_end").over(earlier_blocks).alias("_top_before")))
    previous = (F.when(F.col("_row") == 1, F.col("_end_before")).otherwise(F.col("_lag")) if compare == "previous_row"
                else F.greatest("_top", "_top_before"))

    def opens(end: str) -> Column:
        return (~F.coalesce(F.col("_start") <= F.date_add(F.col(end), gap), F.lit(False))).cast("bigint")

    own_end = "_end" if compare == "previous_row" else "_latest"
    rows = rows.withColumns({"_previous": previous}).withColumn("_latest", F.greatest("_previous", "_end"))
    rows = rows.withColumns({"_opens": opens("_previous"), "_more": (F.col("_copies") - 1) * opens(own_end)})
    opened = rows.groupBy(*part).agg(F.sum(F.col("_opens") + F.col("_more")).alias("_n"))
    rows = with_handed(rows, handed(opened, F.coalesce(F.sum("_n").over(earlier_blocks), F.lit(0)).alias("_opened")))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (rows.withColumn("_last", F.col("_opened") + F.sum(F.col("_opens") + F.col("_more")).over(running))
            .withColumn("era", F.explode(F.sequence(F.col("_last") - F.col("_more"), F.col("_last"))))
            .groupBy("person_id", "era")
            .agg(na_agg(F.min, "_start").alias("start_date"), na_agg(F.max, "_end").alias("last_intake"))
            .withColumn("drug_days", F.datediff("last_intake", "start_date")))


def eras_near_index(eras: DataFrame, cases: DataFrame, *, days: int = k.LOOKBACK_DAYS) -> DataFrame:
    """Eras that last into the look-back window or beyond, with the person's entry and index date."""
    dates = cases.select("person_id", "enroll_date", F.col("indexdt").alias("index_date"))
    return (eras.join(shuffled(dates), "person_id")
            .filter(F.col("last_intake") > F.date_sub("index_date", days)))


def exposure_period(eras: DataFrame, *, follow_up: int = k.FOLLOW_UP_DAYS) -> DataFrame:
    """Whole period of use per person, and the date it leaves the cohort."""
    return (eras.groupBy("person_id")
            .agg(na_agg(F.min, "start_date").alias("entire_start"), na_agg(F.max, "last_intake").alias("entire_end"),
                 F.date_add(F.max("last_intake"), follow_up).alias("cohort_out_date")))
