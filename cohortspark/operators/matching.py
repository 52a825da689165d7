"""Matched controls: up to k per case, each control used once, cases served in case-number order.

A control's eligibility depends only on its exact-match columns, its age and its entry date. Controls of one
(exact columns, age) *strip* are numbered by entry date, so the controls a case may take are one run of consecutive
numbers in each of the strips its age band touches. Those runs are found on counts per (strip, day), a grid bounded
by the calendar, and no case is ever joined to a whole group of candidates.

Laid end to end, the runs of a case number its candidates 0 to total - 1. The case prefers them in one fixed random
order: turn t names candidate ``scrambled(t)``, a keyed bijection of the next power of two in plain integer arithmetic,
and turns that name no candidate are passed over. The order needs no list, so a case reads it page by page and only as
far as it must, and the page size changes nothing but the work.

If every control prefers the lowest case number, the stable matching of these orders equals serving the cases one by
one, and it can be found in parallel rounds. Each short case reads its next page, leaves out controls that a lower case
holds, and proposes to the first ones it still needs. A control goes to its lowest proposer; the other proposers, and
the holder it had, are short and go on in the next round from where they stopped. A round is one job that writes what
its short cases asked for, under the numbers of the places, not of persons; holders and reading places follow from all
rounds so far, which the next round reads as one scan. So every round has the same plan. A case reads on in every round,
and an order is finite, so the rounds end; a case ends with fewer than k controls only when lower-numbered cases hold
every other eligible one.

Cases of one cell (same exact columns, age and day) share their eligible controls and are served in order, so once the
cases before one must have used them all up it cannot get any, and is left out.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from cohortspark import constants as k
from cohortspark.storage import Scratch, shuffled

_LOG = logging.getLogger(__name__)
_SALTS = 256        # fixed value: controls of a day are numbered by person_id % _SALTS, then person_id
_BLOCK_BITS = 16
_CHUNK = 1024        # turns of a page that one row holds
# Multipliers and key factors of the preference order, odd and below 2**20 so that no product overflows.
_SCRAMBLE = ((668_265, 374_761, 15_731), (524_309, 789_221, 48_271), (907_633, 126_613, 69_069))


def control_pool(cohort: DataFrame, cases: DataFrame) -> DataFrame:
    """Members who never become a case, one row each, with their age in full years at entry."""
    return (cohort.join(shuffled(cases.select("person_id")), "person_id", "left_anti")
            .withColumn("age", F.floor("age").cast("int")))


def candidate_counts(cases: DataFrame, pool: DataFrame, *, exact: Sequence[str] = ("gender_concept_id",),
                     age_band: int = k.AGE_BAND, date_band: int = k.ENTRY_BAND) -> DataFrame:
    """Number of eligible controls of every case, without listing them."""
    runs = _runs(_on_grid(cases), _cells(_on_grid(pool), exact), exact, age_band, date_band)
    return (_on_grid(cases).join(shuffled(runs), [*exact, "age", "day"], "left")
            .select("case_number", F.coalesce("total", F.lit(0)).cast("bigint").alias("candidates")))


def match_controls(cases: DataFrame, pool: DataFrame, scratch: Scratch, *,
                   exact: Sequence[str] = ("gender_concept_id",), controls: int = k.CONTROLS_PER_CASE,
                   age_band: int = k.AGE_BAND, date_band: int = k.ENTRY_BAND, seed: int = 42,
                   page: int = 32) -> DataFrame:
    """The matched (case_number, person_id) pairs. A case reads ``page`` turns at first, then as many as it has read."""
    if controls < 1 or page < 1:
        raise ValueError("a case needs at least one control and one turn")
    cases, pool = _on_grid(cases), _on_grid(pool)
    place = [*exact, "strip", "position"]
    positions = scratch.cut(_positions(pool, exact), "positions")
    served = scratch.cut(_served(cases, pool, tuple(exact), age_band, date_band, controls), "served")
    paths: list[str] = []
    state, latest = None, None
    while True:
        asked = _round(served, state, latest, exact, seed=seed, page=page, controls=controls)
        seen = Observation()
        paths.append(scratch.write(asked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("open").alias("open")), "asked"))
        state, latest = scratch.read(paths, asked.schema), scratch.read(paths[-1], asked.schema)   # one scan of all rounds
        _LOG.info("round %d: %d rows, %d open", len(paths), seen.get["rows"], seen.get["open"])
        if not seen.get["open"]:
            break
    held = state.filter("winner = case_number").groupBy(*place).agg(F.min("case_number").alias("case_number"))
    return shuffled(held).join(positions, place).select("case_number", "person_id")


def _scrambled(turn: str, seed: int) -> str:
    """The candidate that a turn names: odd multiples, key additions and xor-shifts, each a bijection of ``bits`` bits."""
    keys = ", ".join(f"struct({times}L AS times, {of_case}L AS of_case, {seed % (1 << 40) * of_seed}L AS added)" for times, of_case, of_seed in _SCRAMBLE)
    step = f"((x * k.times + (case_number & {(1 << 40) - 1}) * k.of_case + k.added) & (turns - 1))"
    return f"aggregate(array({keys}), {turn}, (x, k) -> {step} ^ shiftright({step}, 1 + bits DIV 2))"


def _round(served: DataFrame, state: DataFrame | None, latest: DataFrame | None, exact: Sequence[str], *, seed: int, page: int,
           controls: int) -> DataFrame:
    """One round as one statement, which is the same in every round after the first, so that its code is compiled once.

    ``state`` holds what all earlier rounds asked, ``latest`` what the last of them did. From it follow the holder of each place (every holder is lower than the one
    before), and of the last round the *short* cases: those that took part or lost a control, and still lack some. A short
    case reads its page (rows of at most ``_CHUNK`` turns), proposes to the first places that no lower case holds, and the
    lowest proposer of a place wins it; every proposer is lower than the holder. A case without a free place on its page keeps
    one row without a place. ``open`` says that somebody lacks a control after the row. Both joins shuffle, so nothing of a round passes
    through the driver.
    """
    keys = ", ".join(f"`{c}`" for c in exact)
    same = " AND ".join(f"r.`{c}` = h.`{c}`" for c in (*exact, "strip", "position"))
    losses = f"""
      events AS (SELECT case_number, next_cursor AS cursor, CAST(NULL AS BIGINT) AS asked, 0L AS change FROM {{state}}
                 UNION ALL SELECT case_number, next_cursor, need, CASE WHEN winner = case_number THEN -1L ELSE 0L END FROM {{latest}}
                 UNION ALL SELECT holder, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), 1L FROM {{latest}} WHERE winner = case_number AND holder IS NOT NULL),
      losses AS (SELECT * FROM (SELECT case_number, max(cursor) AS cursor, coalesce(max(asked), 0L) + sum(change) AS need FROM events GROUP BY case_number)
                 WHERE need > 0),
      held AS (SELECT {keys}, strip, position, min(case_number) AS holder FROM {{state}} WHERE winner = case_number GROUP BY {keys}, strip, position),
      short AS (SELECT /*+ SHUFFLE_HASH(losses) */ served.*, cursor, need FROM {{served}} AS served
                JOIN losses ON served.case_number = losses.case_number WHERE cursor < {_turns('total')}),"""
    first = f"short AS (SELECT *, 0L AS cursor, {controls}L AS need FROM {{served}}),"
    text = f"""
      WITH {first if state is None else losses}
      pages AS (SELECT *, length(bin(total - 1)) AS bits, {_turns('total')} AS turns, least(cursor + greatest(cursor, {page}L), {_turns('total')}) AS stop FROM short),
      chunks AS (SELECT *, explode(sequence(cursor, stop - 1, {_CHUNK}L)) AS start FROM pages),
      turns_read AS (SELECT *, explode(concat(sequence(start, least(start + {_CHUNK}L, stop) - 1),
                                              CASE WHEN start = cursor THEN array(-1L) ELSE array() END)) AS turn FROM chunks),
      numbered AS (SELECT *, explode(array({_scrambled('turn', seed)})) AS number FROM turns_read),
      named AS (SELECT case_number, {keys}, need, stop, CASE WHEN turn >= 0 THEN turn END AS turn, number,
                       CASE WHEN turn >= 0 THEN get(filter(runs, r -> number >= r.first AND number < r.first + r.size), 0) END AS run
                FROM numbered WHERE turn < 0 OR number < total),
      rows AS (SELECT case_number, {keys}, need, stop, turn, run.strip AS strip, run.lo + number - run.first AS position FROM named),
      placed AS (SELECT *, position IS NOT NULL AND coalesce(holder > case_number, true) AS free
                 FROM (SELECT {'r.*, CAST(NULL AS BIGINT) AS holder FROM rows r' if state is None else f'/*+ SHUFFLE_HASH(h) */ r.*, h.holder FROM rows r LEFT JOIN held h ON {same}'})),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY case_number ORDER BY free DESC, turn NULLS LAST) AS rank FROM placed),
      kept AS (SELECT *, max(CASE WHEN free AND rank = need THEN turn + 1 END) OVER (PARTITION BY case_number) AS reached
               FROM ranked WHERE free AND rank <= need OR NOT free AND rank = 1),
      asked AS (SELECT case_number, {keys}, strip, CASE WHEN free THEN position END AS position, need, holder,
                       coalesce(reached, stop) AS next_cursor, reached IS NULL AS unmet FROM kept),
      won AS (SELECT *, CASE WHEN position IS NOT NULL THEN min(case_number) OVER (
                PARTITION BY {keys}, strip, position, CASE WHEN position IS NULL THEN case_number END) END AS winner FROM asked)
      SELECT case_number, {keys}, strip, position, need, next_cursor, holder, winner,
             unmet OR holder IS NOT NULL OR winner <> case_number AS open FROM won"""
    tables = {"served": served} if state is None else {"served": served, "state": state, "latest": latest}
    return served.sparkSession.sql(text, **tables)


def _turns(total: str) -> str:
    """The length of the preference order: the power of two that is not below the number of candidates."""
    return f"shiftleft(1L, length(bin({total} - 1)))"


def _on_grid(people: DataFrame) -> DataFrame:
    return people.withColumn("day", F.unix_date("enroll_date"))


def _salt() -> Column:
    return F.pmod(F.col("person_id"), F.lit(_SALTS))


def _cells(pool: DataFrame, exact: Sequence[str]) -> DataFrame:
    return pool.groupBy(*exact, "age", "day").agg(F.count(F.lit(1)).alias("n"))


def _runs(cases: DataFrame, cells: DataFrame, exact: Sequence[str], age_band: int, date_band: int) -> DataFrame:
    """Per case cell (exact columns, age, day): its runs of control numbers, at most one per age of the band."""
    wanted = (cases.select(*exact, "age", "day").distinct()
              .withColumns({"case_age": F.col("age"), "n": F.lit(0).cast("bigint"),
                            "age": F.explode(F.sequence(F.col("age") - age_band, F.col("age") + age_band))}))
    strip = Window.partitionBy(*exact, "age").orderBy("day")
    near = strip.rangeBetween(-date_band, date_band)
    before = strip.rangeBetween(Window.unboundedPreceding, -date_band - 1)
    grid = cells.withColumn("case_age", F.lit(None).cast("int")).unionByName(wanted)
    lengths = (grid.withColumns({"size": F.sum("n").over(near), "lo": F.coalesce(F.sum("n").over(before), F.lit(0))})
               .filter(F.col("case_age").isNotNull() & (F.col("size") > 0)))
    by_age = (Window.partitionBy(*exact, "case_age", "day").orderBy("age")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (lengths.withColumn("first", F.coalesce(F.sum("size").over(by_age), F.lit(0)))
            .groupBy(*exact, F.col("case_age").alias("age"), "day")
            .agg(F.collect_list(F.struct("first", "size", "lo", F.col("age").alias("strip"))).alias("runs"),
                 F.sum("size").alias("total")))


def _positions(pool: DataFrame, exact: Sequence[str]) -> DataFrame:
    """Controls numbered within their strip in day order. Days are split by a salt, so that a day on which a large
    share of all people entered is numbered by many tasks."""
    salted = pool.select("person_id", *exact, "age", "day", _salt().alias("salt"))
    part = [*exact, "age", "day", "salt"]
    before = (Window.partitionBy(*exact, "age").orderBy("day", "salt")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = (salted.groupBy(*part).agg(F.count(F.lit(1)).alias("n"))
              .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    rank = F.row_number().over(Window.partitionBy(*part).orderBy("person_id"))
    return (salted.join(shuffled(starts), part)
            .select(*exact, F.col("age").alias("strip"), (F.col("start") + rank - 1).alias("position"), "person_id"))


def _served(cases: DataFrame, pool: DataFrame, exact: Sequence[str], age_band: int, date_band: int,
            taken_by_each: int) -> DataFrame:
    """Cases with the runs of their cell, without those that come after the cell's controls are used up.

    Cases are ranked in their cell by blocks of consecutive numbers, so a cell that holds a large share of all cases
    is ranked by many tasks, and blocks too far back are dropped before their cases are read.
    """
    runs = _runs(cases, _cells(pool, exact), exact, age_band, date_band)
    cell = [*exact, "age", "day"]
    places = cases.select("case_number", *cell, F.shiftright("case_number", _BLOCK_BITS).alias("block"))
    earlier = Window.partitionBy(*cell).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (places.groupBy(*cell, "block").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
              .join(shuffled(runs), cell).filter(F.col("ahead") * taken_by_each < F.col("total")))
    in_block = F.row_number().over(Window.partitionBy(*cell, "block").orderBy("case_number"))
    return (places.join(shuffled(blocks), [*cell, "block"])
            .withColumn("ahead", F.col("ahead") + in_block - 1)
            .filter(F.col("ahead") * taken_by_each < F.col("total"))
            .select("case_number", *exact, "runs", "total"))
