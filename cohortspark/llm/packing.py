"""Packing documents into sequences of bounded length by bin completion."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.tokens import default_ranks, encoder
from cohortspark.storage import Scratch

Pattern = tuple[tuple[int, int], ...]   # (length, how often) of one sequence

TASKS = 2_048   # so many rows of at most ``limit`` counts are broadcast at a time: 32 MB with the usual limit
PIECES = "doc struct<id:{id}>, piece int, start long, length int, ids binary, part long, nth long"


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, end: int = 2,
           ranks: str | None = None, added: dict[str, int] | None = None) -> DataFrame:
    """Each document's ids and a final ``end``, cut into pieces of ``limit`` ids; the first piece may be shorter.

    ``added`` are the strings that are single ids inside a text (see ``encoder``); by default there are none.
    ``ids`` holds little-endian unsigned 32-bit ids. (part, nth) numbers the pieces of each length within a task.
    """
    path = ranks or default_ranks()
    id_type = df.schema[id_col].dataType.simpleString()

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, added), TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, np.int64)
        for batch in batches:
            ids_in, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                places, columns = [], ([], [], [], [], [])
                for k in range(at, min(at + 256, batch.num_rows)):
                    ids = encode(texts[k].as_py() or "")
                    ids.append(end)
                    data = np.array(ids, "<u4").tobytes()
                    cut = [0, *range(len(ids) % limit or limit, len(ids) + 1, limit)]
                    for piece, (i, j) in enumerate(zip(cut, cut[1:])):
                        places.append(k)
                        for column, value in zip(columns, (piece, i, j - i, data[4 * i:4 * j], int(seen[j - i]))):
                            column.append(value)
                        seen[j - i] += 1
                doc = pa.StructArray.from_arrays([ids_in.take(pa.array(places, pa.int64()))], names=["id"])
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()),
                     pa.array(columns[3], pa.binary()), pa.array(np.full(len(places), part, np.int64)), pa.array(columns[4], pa.int64())],
                    names=["doc", "piece", "start", "length", "ids", "part", "nth"])

    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(emit, PIECES.format(id=id_type))


def dominates(one: Pattern, other: Pattern, tries: int = 200) -> bool:
    """Whether the pieces of ``other`` can be shared out so that each share fits into a piece of ``one`` of its own.

    Then whatever a plan with ``other`` does with the pieces of ``one`` can be done with the shares in their place. An answer not
    found within ``tries`` placements is no: the filling is kept.
    """
    rooms = [length for length, times in one for _ in range(times)]
    items = [length for length, times in other for _ in range(times)]
    if sum(items) > sum(rooms) or (items and (not rooms or items[0] > rooms[0])):
        return False
    left = [tries]

    def place(k: int) -> bool:
        if k == len(items):
            return True
        left[0] -= 1
        if left[0] < 0:
            return False
        seen = set()
        for i, room in enumerate(rooms):
            if room >= items[k] and room not in seen:
                seen.add(room)
                rooms[i] -= items[k]
                if place(k + 1):
                    return True
                rooms[i] += items[k]
        return False

    return len(items) <= tries and place(0)


def _fillings(counts: list[int], lengths: list[int], room: int, waste: int, width: int, steps: int) -> list[Pattern]:
    """Undominated ways to fill ``room`` with what is left, wasting at most ``waste``; at most ``width``, least waste first.

    Longer pieces first, as deep as the room allows; ``steps`` pieces are tried. ``fitting[r]`` is the first length of at most r.
    """
    found: list[tuple[int, int, Pattern]] = []
    left, exact = [steps], [0]
    fitting, k = [len(lengths)] * (room + 1), len(lengths)
    for r in range(room + 1):
        while k and lengths[k - 1] <= r:
            k -= 1
        fitting[r] = k

    def extend(i: int, room: int, chosen: Pattern, pieces: int) -> None:
        if left[0] <= 0 or exact[0] >= width:
            return
        left[0] -= 1
        i = max(i, fitting[room])
        if i == len(lengths):
            if room <= waste and not any(w <= room and n <= pieces and dominates(f, chosen) for w, n, f in found):
                found.append((room, pieces, chosen))
                exact[0] += room == 0
            return
        length = lengths[i]
        for times in range(min(counts[length], room // length), -1, -1):
            extend(i + 1, room - times * length, (*chosen, (length, times)) if times else chosen, pieces + times)

    extend(0, room, (), 0)
    found.sort()
    kept: list[Pattern] = []
    for _, _, filling in found:   # a later one may dominate an earlier one
        if not any(dominates(f, filling) for f in kept):
            kept.append(filling)
    return kept[:width]


def best_fit(histogram: dict[int, int], limit: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing, for all pieces of a length at once: they go to the fullest sequences that still take one."""
    rooms: list[dict[Pattern, int]] = [{} for _ in range(limit + 1)]   # sequences by room left, then by pattern
    rooms[limit][()] = sum(histogram.values())   # more empty sequences than can be needed
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = length
        while left:
            if not rooms[room]:
                room += 1
                continue
            pattern, number = next(iter(rooms[room].items()))
            fits = room // length
            used, times = (min(number, left // fits), fits) if left >= fits else (1, left)
            after = room - times * length
            filled = (*pattern, (length, times))
            rooms[after][filled] = rooms[after].get(filled, 0) + used
            rooms[room][pattern] -= used
            if not rooms[room][pattern]:
                del rooms[room][pattern]
            left -= used * times
            room = length   # what is left of the sequence may be the best fit now
    return [(pattern, number) for group in rooms for pattern, number in group.items() if pattern]


def lower_bound(histogram: dict[int, int], limit: int) -> int:
    """No plan needs fewer sequences: pieces over half need one each, and for each size k, those too long to go with a piece of
    size k have no use for the pieces between k and half."""
    best = -(-sum(length * n for length, n in histogram.items()) // limit)
    for k in sorted({length for length in histogram if 2 * length <= limit} | {0}):
        alone = sum(n for length, n in histogram.items() if length > limit - k)
        half = [(length, n) for length, n in histogram.items() if 2 * length > limit and length <= limit - k]
        small = sum(length * n for length, n in histogram.items() if k <= length and 2 * length <= limit)
        spare = sum((limit - length) * n for length, n in half)
        best = max(best, alone + sum(n for _, n in half) + max(0, -(-(small - spare) // limit)))
    return best


def complete(histogram: dict[int, int], limit: int, incumbent: list[tuple[Pattern, int]], nodes: int, width: int = 3,
             steps: int = 400) -> list[tuple[Pattern, int]]:
    """Bin completion: the fewest sequences found, at most as many as the incumbent has.

    Take the largest piece left, complete its sequence with an undominated filling, use that pattern as often as the pieces
    allow, and go on; fillings of least waste first. A branch ends when its waste leaves no way to beat the incumbent. The search
    ends at the lower bound or after ``nodes`` patterns.
    """
    total = sum(length * n for length, n in histogram.items())
    bound = lower_bound(histogram, limit)
    best, best_size = incumbent, sum(times for _, times in incumbent)
    counts = [0] * (limit + 1)
    for length, n in histogram.items():
        counts[length] = n
    stack: list[tuple[list[int], tuple, int, int]] = [(counts, (), 0, 0)]   # counts left, chosen (linked), used, wasted
    while stack and best_size > bound and nodes > 0:
        counts, chosen, used, wasted = stack.pop()
        largest = next((n for n in range(limit, 0, -1) if counts[n]), 0)
        if not largest:
            if used < best_size:
                best, best_size = [], used
                while chosen:
                    best.append(chosen[0])
                    chosen = chosen[1]
            continue
        allowed = (best_size - 1) * limit - total - wasted
        if allowed < 0:
            continue
        nodes -= 1
        room = limit - largest
        counts[largest] -= 1
        lengths = [n for n in range(room, 0, -1) if counts[n]]
        options = _fillings(counts, lengths, room, min(allowed, room), width, steps) if lengths else [()]
        counts[largest] += 1
        for filling in reversed(options):
            need: dict[int, int] = {largest: 1}
            for length, times in filling:
                need[length] = need.get(length, 0) + times
            repeat = min(counts[length] // times for length, times in need.items())
            after = counts.copy()
            for length, times in need.items():
                after[length] -= repeat * times
            spare = limit - sum(a * b for a, b in need.items())
            if repeat * spare <= allowed:
                pattern = tuple(sorted(need.items(), reverse=True))
                stack.append((after, ((pattern, repeat), chosen), used + repeat, wasted + repeat * spare))
    return best


def plan(histogram: dict[int, int], limit: int, nodes: int = 2_000, reopened: tuple[int, ...] = (20, 40, 80, 160, 320)) -> list[tuple[Pattern, int]]:
    """Patterns and how many sequences use each, for the given number of pieces of each length.

    Each pattern is listed once. Best fit gives the incumbent. Bin completion then searches for a better plan of all pieces, and again of the pieces of
    the 20, 40, ... sequences with the most room, where a small search is nearly complete. Work depends on the
    number of different lengths, not of pieces.
    """
    best = complete(histogram, limit, best_fit(histogram, limit), nodes)
    for number in reopened:
        if sum(times for _, times in best) <= lower_bound(histogram, limit):
            break
        opened: list[tuple[Pattern, int]] = []
        rest: list[tuple[Pattern, int]] = []
        for pattern, times in sorted(best, key=lambda p: sum(a * b for a, b in p[0])):
            take = min(times, number)
            number -= take
            opened += [(pattern, take)] if take else []
            rest += [(pattern, times - take)] if times > take else []
        part: dict[int, int] = {}
        for pattern, times in opened:
            for length, n in pattern:
                part[length] = part.get(length, 0) + n * times
        best = rest + complete(part, limit, opened, nodes)
    merged: dict[Pattern, int] = {}
    for pattern, times in best:
        merged[pattern] = merged.get(pattern, 0) + times
    return list(merged.items())


def _slots(spark: SparkSession, patterns: list[tuple[Pattern, int]]) -> DataFrame:
    """Where the pieces of a length go, by their rank: (length, from, to, first_sequence, per_sequence, first_offset)."""
    rows, first, taken = [], 0, {}
    for pattern, repeat in patterns:
        offset = 0
        for length, times in pattern:
            begin = taken.get(length, 0)
            taken[length] = begin + repeat * times
            rows.append((length, begin, taken[length], first, times, offset))
            offset += length * times
        first += repeat
    return spark.createDataFrame(rows, "length int, rank_from long, rank_to long, first_sequence long, times long, first_offset long")


def pack(scratch: Scratch, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, end: int = 2,
         ranks: str | None = None, added: dict[str, int] | None = None) -> DataFrame:
    """Pieces of all documents with their place: (id, piece, start, length, ids, sequence_id, offset).

    Tokenised pieces are written once. Only the number of pieces of each length (at most ``limit`` numbers) reaches the
    driver, where ``plan`` chooses patterns; pieces find their sequence by their rank among pieces of the same length, which is
    their place within the task plus the pieces of the tasks before. Those numbers are one small row a task, broadcast for
    ``TASKS`` tasks at a time to the pieces that these tasks wrote, so that no ids are shuffled. Ties between pieces of a length are arbitrary.
    A null text is an empty document, which is the final id alone. Null ids and repeated rows are packed like any others.
    An empty table gives no pieces. Extra columns are ignored. ``sequences`` joins the ids of each sequence.
    """
    cut = scratch.cut(pieces(df, id_col, text_col, limit, end, ranks, added), "pieces")
    counts = scratch.cut(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}   # at most limit rows
    slots = _slots(df.sparkSession, plan(histogram, limit))
    earlier = F.expr("coalesce(sum(n) OVER (PARTITION BY length ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    offsets = scratch.cut(counts.select("length", "part", earlier.alias("earlier")).groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("length", "earlier"))).alias("earlier")), "offsets")   # at most limit entries a task
    parts = offsets.agg(F.coalesce(F.max("part") + 1, F.lit(1))).first()[0]
    ranked = reduce(DataFrame.unionAll, [
        cut.filter(of_tasks).join(F.broadcast(offsets.filter(of_tasks)), "part").withColumn("rank", F.expr("earlier[length] + nth"))
        for of_tasks in (F.col("part").between(first, first + TASKS - 1) for first in range(0, parts, TASKS))])
    placed = ranked.join(F.broadcast(slots.withColumnRenamed("length", "of")),   # a few patterns a length, whatever the number of rows
                         (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return placed.select(
        F.col("doc.id").alias("id"), "piece", "start", F.col("length").cast("long").alias("length"), "ids",
        (F.col("first_sequence") + F.expr("(rank - rank_from) DIV times")).alias("sequence_id"),
        (F.col("first_offset") + (F.col("rank") - F.col("rank_from")) % F.col("times") * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, documents): the joined ids of each sequence, at most ``limit`` of them."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "id")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"])).alias("ids"),
        F.col("parts.id").alias("documents"))
