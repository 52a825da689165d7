"""Exact top-k search by inner product, with pivot tables that rule candidates out."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.storage import Scratch

BLOCK = "block long, dim int, n int, vectors binary, ids binary"
CANDIDATES = f"{BLOCK}, copies binary, largest binary, lows binary, highs binary"
QUERIES = f"{BLOCK}, distances binary"
FOUND = "query_id long, q_block long, q_row int, vec_id long, score long, beyond int, copies long"
_LONG = 1 << 63
_LARGEST = int(np.finfo(np.float64).max)

# Pairs of rows that make a task worth its start, numbers that a task holds about its queries, hits that are merged at once.
_TASK_PAIRS, _TASK_NUMBERS, _HITS = 1 << 26, 1 << 22, 4096


def usable(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """(vec_id, vec, dim, copies): floor(scale * component) of the rows that take part, equal rows as one with their number.

    A double holds every such whole number, however large, as scaling by a power of two is exact. Left out: null ids, and vectors
    that are null or empty or hold null or non-finite components. Components that overflow a double when scaled raise an error.
    """
    x = F.col(f"`{vector_col}`")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))

    def scaled(c: Column) -> Column:
        value = c.cast("double") * scale
        # Rounded down by hand: Spark's floor gives a long, which large components do not fit. -0.0 becomes 0.0.
        small = F.abs(value) < float(1 << 52)
        down = F.when(small, F.floor(F.when(small, value).otherwise(0.0)).cast("double")).otherwise(value)
        return F.when(F.abs(value) < float("inf"), down + 0.0).otherwise(F.raise_error(F.lit("a scaled component does not fit a double")))

    return (df.filter(F.col(f"`{id_col}`").isNotNull() & F.coalesce(fine, F.lit(False)))
            .select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(x, scaled).alias("vec"))
            .groupBy("vec_id", "vec").agg(F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("vec")))


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _whole(vectors: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python's, which are never too large."""
    return np.array([[int(c) for c in v] for v in vectors.tolist()], object).reshape(vectors.shape)


def _stored(vectors: np.ndarray) -> bytes:
    """The whole numbers in as few bytes as hold the largest."""
    top = np.abs(vectors).max()
    return vectors.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.float64).tobytes()


def _read(data: pa.Buffer, n: int, dim: int) -> np.ndarray:
    kind = {2: np.int16, 4: np.int32, 8: np.float64}[len(data) // (n * dim)]
    return np.frombuffer(data, kind).reshape(n, dim).astype(np.float64)


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.stack([np.sqrt(((vectors - p) ** 2).sum(axis=1)) for p in pivots], axis=1)


def _packed(table: pa.Table, vectors: np.ndarray, **more: np.ndarray) -> pa.Table:
    """One block of BLOCK."""
    first = {name: table.column(name)[0].as_py() for name in ("block", "dim")}
    return pa.table({"block": pa.array([first["block"]], pa.int64()), "dim": pa.array([first["dim"]], pa.int32()),
                     "n": pa.array([len(vectors)], pa.int32()), "vectors": [_stored(vectors)],
                     **{name: [np.ascontiguousarray(a).tobytes()] for name, a in more.items()}})


def _within_reach(vectors: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of all rows but those of equal vectors beyond the k + 1 smallest ids: they score as much, and a query of another
    id ranks at least k of those before them. A vector that a large share of the rows has would else tie with all of them."""
    seen: dict[bytes, int] = {}
    group = np.array([seen.setdefault(v.tobytes(), len(seen)) for v in vectors])
    order = np.lexsort((ids, group))
    group = group[order]
    return np.sort(order[np.arange(len(group)) - np.searchsorted(group, group) <= k])


def _candidates(pivots: dict[int, np.ndarray], k: int, step: int):
    """Pack the rows of one block by their nearest pivot. Every ``step`` rows have their largest squared norm, and their least
    and largest distance to every pivot of their dimension."""

    def build(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        vectors = _matrix(table.column("vec").combine_chunks(), dim)
        ids, copies = (table.column(name).to_numpy().astype(np.int64) for name in ("vec_id", "copies"))
        far = _distances(vectors, pivots[dim])
        nearest = far.argmin(axis=1)
        order = np.lexsort((far[np.arange(len(far)), nearest], nearest))
        order = order[_within_reach(vectors[order], ids[order], k)]
        vectors, far, starts = vectors[order], far[order], np.arange(0, len(order), step)
        with np.errstate(over="ignore"):
            norms = (vectors ** 2).sum(axis=1)
        return _packed(table, vectors, ids=ids[order], copies=copies[order], largest=np.maximum.reduceat(norms, starts),
                       lows=np.minimum.reduceat(far, starts, axis=0), highs=np.maximum.reduceat(far, starts, axis=0))

    return build


def _asked(pivots: dict[int, np.ndarray]):
    """Pack the queries of one block, with their distances to every pivot of their dimension."""

    def build(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        vectors = _matrix(table.column("vec").combine_chunks(), dim)
        return _packed(table, vectors, ids=table.column("vec_id").to_numpy().astype(np.int64), distances=_distances(vectors, pivots[dim]))

    return build


class _Best:
    """The queries of a block and the best k candidates of each so far: rows in order, candidates by score and id."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, far: np.ndarray, k: int):
        self.vectors, self.ids, self.far, self.k = vectors, ids, far, k
        with np.errstate(over="ignore"):
            self.norms, self.singles = (vectors ** 2).sum(axis=1), vectors.astype(np.float32)
        self.lengths, self.top = np.sqrt(self.norms), int(np.abs(vectors).max())
        self.kth = np.full(len(ids), -np.inf)   # as a double, rounded; of queries with k candidates
        self.found = (np.zeros(0, np.int64),) * 4   # row, vec_id, score, copies
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def add(self, *hits: np.ndarray) -> None:
        self.waiting.append(hits)
        if sum(len(h[0]) for h in self.waiting) >= _HITS:
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        rows, ids, scores, copies = (np.concatenate(column) for column in zip(self.found, *self.waiting))
        self.waiting.clear()
        if scores.dtype == object:
            order = np.array(sorted(range(len(rows)), key=lambda i: (rows[i], -scores[i], ids[i])), np.int64)
        else:
            order = np.lexsort((ids, -scores, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = place < self.k
        self.found = (rows[kept], *(a[order][kept] for a in (ids, scores, copies)))
        last = place == self.k - 1
        worst = scores[order][last]
        if worst.dtype == object:   # a limit below the score rules nothing out that belongs in
            worst = np.array([float(min(s, _LARGEST)) if s >= -_LARGEST else -np.inf for s in worst], np.float64)
        self.kth[rows[last]] = worst

    def batch(self, block: int) -> pa.RecordBatch:
        self.merge()
        rows, ids, scores, copies = self.found
        # A score that does not fit a long stands at the end of its range, marked by its side.
        beyond = [1 if s >= _LONG else -1 if s < -_LONG else 0 for s in scores.tolist()]
        columns = (pa.array(self.ids[rows]), pa.array(np.full(len(rows), block, np.int64)), pa.array(rows.astype(np.int32)), pa.array(ids),
                   pa.array([max(-_LONG, min(_LONG - 1, s)) for s in scores.tolist()], pa.int64()), pa.array(beyond, pa.int32()), pa.array(copies))
        return pa.RecordBatch.from_arrays(list(columns), names=["query_id", "q_block", "q_row", "vec_id", "score", "beyond", "copies"])


class _Candidates:
    """The rows of a candidate block, and what bounds the products of every ``step`` of them."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, copies: np.ndarray, lows: np.ndarray, highs: np.ndarray, largest: np.ndarray):
        self.vectors, self.ids, self.copies, self.lows, self.highs, self.largest = vectors, ids, copies, lows, highs, largest
        with np.errstate(over="ignore"):
            self.singles = vectors.astype(np.float32)
        self.lengths, self.top = np.sqrt(largest), int(np.abs(vectors).max())


def _upper(best: _Best, found: _Candidates) -> np.ndarray:
    """What the product of a query (row) and a candidate out of some (column) cannot exceed: the largest gap over all pivots
    between the query's distance and theirs bounds their distance from below, and so the product from above."""
    less, more = 1 - 1e-9, 1 + 1e-9   # rounding of the distances
    with np.errstate(over="ignore", invalid="ignore"):
        far = best.far[:, None]
        gap = np.maximum(np.maximum(far * less - found.highs * more, found.lows * less - far * more).max(axis=2), 0)
        both = best.norms[:, None] + found.largest
        upper = (both - gap * gap) / 2 + 1e-6 * (1 + both)
    upper[~np.isfinite(upper)] = np.inf   # squares beyond a double bound nothing
    return upper


def _scores(q: np.ndarray, x: np.ndarray, rows: np.ndarray, places: np.ndarray, largest: int) -> np.ndarray:
    """Exact products of single pairs. The largest sum of products decides whether doubles, longs or only Python's whole numbers
    hold every sum."""
    if 1 << 53 <= largest < 1 << 62:
        q, x = q.astype(np.int64), x.astype(np.int64)
    elif largest >= 1 << 62:
        q, x = _whole(q), _whole(x)
    parts = [(q[rows[i:i + 1024]] * x[places[i:i + 1024]]).sum(axis=1) for i in range(0, len(rows), 1024)]
    scores = np.concatenate(parts)
    return scores.astype(np.int64) if largest < 1 << 53 else scores


def _search(k: int, step: int):
    """Scores pairs of (candidate block, query block); queries keep their best k from block to block within the task."""

    def score(best: _Best, found: _Candidates, rows: np.ndarray, at: int, end: int, length: float) -> None:
        """Of some queries with the candidates from at to end, of which none is longer than length."""
        dim, ids = found.vectors.shape[1], found.ids[at:end]
        largest = dim * best.top * found.top
        # Products are first taken in floats if those hold every sum, and with all that rounding can take if not out of reach, exactly.
        floats = largest < 1 << 120
        q, x, unit = (best.singles, found.singles, 2.0 ** -23) if floats else (best.vectors, found.vectors, 2.0 ** -52)
        with np.errstate(over="ignore", invalid="ignore"):
            products = (q if len(rows) == len(q) else q[rows]) @ x[at:end].T
            slack = (dim + 4) * unit * best.lengths[rows] * length
            limit = best.kth[rows] - slack
            first = np.flatnonzero(limit == -np.inf)
            if floats and len(first) and len(ids) >= k:   # the k best of these candidates are a limit, too
                others = np.where(ids == best.ids[rows[first], None], -np.inf, products[first])
                limit[first] = np.partition(others, len(ids) - k, axis=1)[:, len(ids) - k] - 2 * slack[first]
            limit = np.nextafter(limit.astype(products.dtype), products.dtype.type(-np.inf))
            hits = np.flatnonzero(~(products < limit[:, None]))
        row, place = rows[hits // len(ids)], hits % len(ids)
        other = ids[place] != best.ids[row]
        row, place = row[other], place[other]
        if len(row):
            best.add(row, ids[place], _scores(best.vectors, found.vectors[at:end], row, place, largest), found.copies[at:end][place])

    def meet(best: _Best, found: _Candidates) -> None:
        upper = _upper(best, found)
        if np.isfinite(best.kth).all() and not (upper < best.kth[:, None]).any():
            return score(best, found, np.arange(len(best.ids)), 0, len(found.ids), found.lengths.max())
        for part in np.argsort(-upper.mean(axis=0), kind="stable").tolist():
            rows = np.flatnonzero(~(upper[:, part] < best.kth))   # no candidate of the others' part can reach the k-th score
            if len(rows):
                score(best, found, rows, part * step, min((part + 1) * step, len(found.ids)), found.lengths[part])
        if np.isinf(best.kth).any():
            best.merge()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, _Best] = {}
        held, candidates = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                value = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
                data = {name: v.as_buffer() for name, v in value.items() if pa.types.is_binary(v.type)}
                block, q_block, dim, n, q_n = (value[name].as_py() for name in ("block", "q_block", "dim", "n", "q_n"))
                if (block, dim) != held:   # pairs come by candidate block
                    lows, highs = (np.frombuffer(data[name]).reshape(-(-n // step), -1) for name in ("lows", "highs"))
                    candidates = _Candidates(_read(data["vectors"], n, dim), np.frombuffer(data["ids"], np.int64),
                                             np.frombuffer(data["copies"], np.int64), lows, highs, np.frombuffer(data["largest"]))
                    held = (block, dim)
                if q_block not in asked:
                    asked[q_block] = _Best(_read(data["q_vectors"], q_n, dim), np.frombuffer(data["q_ids"], np.int64).copy(),
                                           np.frombuffer(data["q_distances"]).reshape(q_n, -1).copy(), k)
                meet(asked[q_block], candidates)
        for q_block, best in asked.items():
            yield best.batch(q_block)

    return run


def _grid(pairs: int, blocks: int, numbers: int, q_blocks: int, partitions: int, shards: int | None) -> tuple[int, int]:
    """Into how many partitions candidates and queries go; each pair of partitions is a task.

    Every task that meets a query returns its best k, so the candidates are in fewer partitions than there are tasks; the more
    the queries are divided, the more often the candidates are read. About 4 times the root of the tasks keeps both small.
    """
    tasks = max(1, min(2 * partitions, -(-pairs // _TASK_PAIRS)))
    shards = min(blocks, shards or min(tasks, math.ceil(4 * math.sqrt(tasks))))
    return shards, min(q_blocks, max(-(-tasks // shards), -(-numbers // _TASK_NUMBERS)))


def top_k(scratch: Scratch, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10,
          pivots: int = 24, block_rows: int = 2048, query_rows: int = 256, shards: int | None = None, step: int = 128) -> DataFrame:
    """The ``k`` best inner products of every query: (query_id, rank, vec_id, score), ties to the smaller vec_id.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with another id and as many components.
    Vectors are whole numbers (see ``usable``, which says what is left out), so scores are exact.

    Pivots are the ``pivots`` rows of each dimension with the smallest hash, a bounded sample; every row is indexed by its
    distances to all of them. Rows are packed into blocks of about ``block_rows`` by hash, in a block by nearest pivot. A query
    block meets every candidate block once: candidate blocks lie in ``shards`` partitions (by default as ``_grid`` says), query
    blocks in others, and a task reads one of each, so that neither side is copied, broadcast or collected. In a block, the pivot
    table bounds the products of every ``step`` candidates from above; they are scored in order of that bound, for the queries
    whose k-th best it reaches.

    Rows that repeat id and vector are one query, but as many candidates; queries that share an id but not the vector are each
    answered. With fewer than ``k`` candidates all are returned; an empty table gives an empty result. Extra columns are ignored.
    Sums are exact at any size of the components; a score of the result that does not fit a long raises an error.
    """
    rows = scratch.cut(usable(df, id_col, vector_col).withColumn("h", F.xxhash64("vec_id", "vec")), "vectors")
    # Spark limits each task to its first rows before the shuffle, as the filter is on the row number.
    sample = rows.select("dim", "vec", "h").withColumn(
        "r", F.expr("row_number() OVER (PARTITION BY dim ORDER BY h, vec)")).filter(F.col("r") <= pivots)
    table: dict[int, list] = {}
    for r in sample.select("dim", "vec").toLocalIterator():   # at most `pivots` vectors per dimension
        table.setdefault(r["dim"], []).append(r["vec"])
    pivot_arrays = {dim: np.array(v, np.float64) for dim, v in table.items()}
    queries = rows.filter(F.col("vec_id") % every == 0)
    n = rows.count()
    numbers = F.sum(F.col("dim").cast("long") + pivots + 4 * k)   # components, distances and the best k of a query
    asked = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(numbers, F.lit(0)).alias("numbers")).first()
    blocks, q_blocks = max(1, -(-n // block_rows)), max(1, -(-asked["n"] // query_rows))
    shards, q_shards = _grid(n * asked["n"], blocks, asked["numbers"], q_blocks,
                             int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards)
    columns = ("vec_id", "vec", "dim", "copies")
    packed = (rows.select(*columns, F.pmod("h", F.lit(blocks)).alias("block")).groupBy("block", "dim")
              .applyInArrow(_candidates(pivot_arrays, k, step), CANDIDATES).repartitionById(shards, (F.col("block") % shards).cast("int")))
    # Written, as the place of a query in its block stands for it from here on.
    q_packed = scratch.cut(queries.select(*columns, F.pmod(F.xxhash64("h"), F.lit(q_blocks)).alias("block")).groupBy("block", "dim")
                           .applyInArrow(_asked(pivot_arrays), QUERIES), "queries")
    q_packed = q_packed.repartitionById(q_shards, (F.col("block") % q_shards).cast("int")).select(
        (F.col("block") * (1 << 31) + F.col("dim")).alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in ("dim", "n", "ids", "vectors", "distances")])
    # The hint names Spark's Cartesian product: a task for each pair of partitions, which reads both where they were written.
    pairs = packed.join(q_packed.hint("shuffle_replicate_nl"), F.col("dim") == F.col("q_dim")).drop("q_dim")
    found = pairs.mapInArrow(_search(k, step), FOUND)
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    ranked = each.withColumn("rank", F.expr("CAST(row_number() OVER (PARTITION BY q_block, q_row ORDER BY score DESC, beyond DESC, vec_id) AS INT)"))
    score = F.when(F.col("beyond") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit a long")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
