"""SimHash near-dedup over an inverted index of positional bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.components import components
from cohortspark.llm.rows import nested, row_key, unnested
from cohortspark.storage import Scratch

BYTES = 8           # a fingerprint has eight positional bytes
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACE = np.arange(BYTES, dtype=np.int64) * 256


def fingerprint(text: str | None, words: int = 4, seed: int = 42, chunk: int = 1 << 16) -> int:
    """64-bit SimHash of the word shingles: a bit is 1 if it is set in over half of the shingle hashes.

    Hashes are taken from the whole text in runs of ``chunk`` shingles, so memory is bounded by the text itself.
    """
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()   # ASCII letters and white space only
    if not parts:
        return 0
    data = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    starts, ends = starts[:n], ends[-n:]
    counts = np.zeros(BYTES * 256, np.int64)
    for at in range(0, n, chunk):
        spans = zip(starts[at:at + chunk].tolist(), ends[at:at + chunk].tolist())
        hashes = np.array([xxh64_intdigest(data[i:j], seed) for i, j in spans], dtype=">u8")
        counts += np.bincount((hashes.view(np.uint8).reshape(-1, BYTES) + _PLACE).ravel(), minlength=BYTES * 256)
    ones = np.einsum("pv,vb->pb", counts.reshape(BYTES, 256), _BITS)
    return int.from_bytes(np.packbits((2 * ones > n).ravel()).tobytes(), "big")


def fingerprints(df: DataFrame, text: str, out: str, words: int = 4) -> DataFrame:
    """Add the fingerprint of the whole text as a (signed) long."""

    @F.pandas_udf("long")
    def of(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).astype(np.int64))

    return df.withColumn(out, of(F.col(text)))


def _keys(parts: int, need: int):
    """Emit (key, fingerprint) for every choice of ``need`` shared parts.

    At level 0 the parts are the eight bytes. An over-full bucket comes back with the mask of the bits its members may
    differ in; these are again cut into eight parts, so level 1 works on 4-bit and level 2 on 2-bit parts.
    """
    choices = list(combinations(range(parts), need))

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            free = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for mask in np.unique(free):
                own = prints[free == mask]
                places = [i for i in range(64) if int(mask) >> i & 1]
                width = len(places) // parts
                groups = [np.uint64(sum(1 << b for b in places[p * width:(p + 1) * width])) for p in range(parts)]
                for at in range(0, len(own), 4096):
                    some = own[at:at + 4096]
                    for chosen in choices:
                        still = np.uint64(int(mask) & ~sum(int(groups[p]) for p in chosen))
                        n = len(some)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, still).view(np.int64)), pa.array((some & ~still).view(np.int64)),
                             pa.array(some.view(np.int64))], names=["free", "shared", "print"])

    return emit


def _bucket_links(prints: np.ndarray, max_bits: int, need: int) -> list[tuple[int, int]]:
    """Links that span the linked groups of one bucket: each member to the smallest one of its group.

    Tallies the positional bytes that each pair shares, keeps pairs that reach the guaranteed minimum, verifies these bit
    by bit, and returns a forest, not all pairs.
    """
    n, out = len(prints), []
    left = np.ones(n, bool)
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        front = prints[root:root + 1]
        while len(front):
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            hit = np.zeros(len(rest), bool)
            for at in range(0, len(front), 64):
                apart = np.bitwise_xor.outer(prints[rest], front[at:at + 64])
                tally = (apart.view(np.uint8).reshape(len(rest), -1, BYTES) == 0).sum(axis=2)
                i, j = np.nonzero(tally >= need)
                near = np.bitwise_count(apart[i, j]) <= max_bits
                hit[i[near]] = True
            found = rest[hit]
            left[found] = False
            out += [(int(prints[root]), int(prints[f])) for f in found]
            front = prints[found]
    return out


def _links(max_bits: int, need: int, limit: int):
    """Stream buckets, sorted by key: small ones give links, members of over-full ones go to the next level."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["free", "a", "b"]

        def send(free, a, b):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.uint64).view(np.int64)) for x in (free, a, b)], names=names)

        open_key, kept, full = None, [], False   # the bucket that may go on in the next batch

        def close():
            if open_key is None or full or len(kept) < 2:
                return None
            pairs = _bucket_links(np.unique(np.array(kept, np.uint64)), max_bits, need)
            return send([0] * len(pairs), [p[0] for p in pairs], [p[1] for p in pairs]) if pairs else None

        for batch in batches:
            free, shared, prints = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(3))
            if not len(free):
                continue
            edges = np.flatnonzero((free[1:] != free[:-1]) | (shared[1:] != shared[:-1])) + 1
            begins, stops = np.concatenate(([0], edges)), np.concatenate((edges, [len(free)]))
            big = np.flatnonzero((stops - begins > 1) | (begins == 0) | (stops == len(free)))   # others are alone
            for s in big:
                i, j = int(begins[s]), int(stops[s])
                key = (int(free[i]), int(shared[i]))
                if key != open_key:
                    if (done := close()) is not None:
                        yield done
                    open_key, kept, full = key, [], False
                own = prints[i:j].tolist()
                if not full and len(kept) + len(own) > limit:
                    full, own, kept = True, kept + own, []
                if full:
                    yield send([key[0]] * len(own), own, [0] * len(own))
                else:
                    kept += own
        if (done := close()) is not None:
            yield done

    return run


def links(scratch: Scratch, prints: DataFrame, column: str, max_bits: int = 4, limit: int = 2048) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join exactly those reachable over steps of at most ``max_bits`` bits.

    Fingerprints within four bits share at least four of their eight positional bytes. The inverted index therefore lists
    each fingerprint under every choice of ``need = 8 - max_bits`` of its (position, byte) entries, so a pair that reaches
    the minimum tally meets in a bucket, and only there; the tally is counted again and the bits are verified.

    A bucket of more than ``limit`` fingerprints (a dense ball of near copies) is indexed once more over the bits in which
    its members can still differ, cut into eight parts; again a pair shares 8 - max_bits of them. With four bits, level 1
    leaves 16 free bits and level 2 leaves 8, so at most 256 distinct members: every level is exact and no group that one
    task holds is larger than ``limit``. ``max_bits`` may be 1 to 4.
    """
    if not 1 <= max_bits <= 4:
        raise ValueError("max_bits must be 1 to 4")
    need = BYTES - max_bits
    level = prints.select(F.col(column).alias("print")).distinct().select("print", F.lit(-1).cast("long").alias("free"))
    found = None
    for depth in range(3):
        indexed = level.mapInArrow(_keys(8, need), "free long, shared long, print long")
        # the buckets of the last level have at most 2 ** (free bits) members, so they are never over-full
        rows = scratch.cut(indexed.repartition("free", "shared").sortWithinPartitions("free", "shared")
                           .mapInArrow(_links(max_bits, need, limit if depth < 2 else 1 << 16), "free long, a long, b long"), "links")
        own = rows.filter("free = 0").select("a", "b")
        found = own if found is None else found.unionByName(own)
        level = rows.filter("free <> 0").select(F.col("a").alias("print"), "free").distinct()
        if level.isEmpty():
            break
    return found


def near_dedup(scratch: Scratch, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
               max_bits: int = 4) -> DataFrame:
    """(key, id, fingerprint, component_id, representative) of every row: near-duplicate groups of whole texts.

    ``key`` digests id and text (see ``rows.row_key``). ``fingerprint`` is 16 lower-case hex digits. ``component_id`` is the
    smallest id that can be reached over links of at most ``max_bits`` differing bits, the row's own included; rows with a
    null id are linked too, and a group without any id has a null one. ``representative`` says whether the row's id is the
    group's; rows that repeat that id are all marked. Null and empty texts and texts of white space have fingerprint zero,
    linked like any other. Repeated rows stay. An empty table gives an empty result.
    """
    rows = scratch.cut(fingerprints(df.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
        row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("key")), "text", "print", words).select("key", "id", "print"), "prints")
    distinct = scratch.cut(rows.groupBy("print").agg(F.min("id").alias("first_id")), "distinct")
    groups = components(scratch, links(scratch, distinct, "print", max_bits))
    labelled = (distinct.join(groups, F.col("print") == F.col("node"), "left")
                .select("print", "first_id", F.coalesce("label", "print").alias("label")))
    labelled = scratch.cut(labelled, "labels")
    smallest = scratch.cut(labelled.groupBy("label").agg(F.min("first_id").alias("component_id")), "smallest")
    named = labelled.join(smallest, "label").select("print", "component_id", F.col("label").alias("component"))
    return rows.join(named, "print").select(
        "key", "id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "component",
        F.col("id").eqNullSafe(F.col("component_id")).alias("representative"))


def drop_near_duplicates(scratch: Scratch, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                         max_bits: int = 4) -> DataFrame:
    """The rows of ``df`` with one document of each near-duplicate group: the one with the smallest id.

    Rows that share this id are told apart by their text's digest, and of rows that are equal in both, one stays.
    """
    groups = scratch.cut(near_dedup(scratch, df, id_col, text_col, words, max_bits), "groups")
    chosen = groups.filter("representative").groupBy("component").agg(F.min("key").alias("key"))
    repeated = groups.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(chosen.select("key"), "key", "left_semi")
    repeated = scratch.cut(repeated.select("key"), "repeated")
    dropped = groups.select("key").join(chosen.select("key"), "key", "left_anti")
    docs = df.select(nested(df).alias("doc"), row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("key"))
    single = docs.join(dropped.unionByName(repeated).distinct(), "key", "left_anti")
    if not repeated.isEmpty():
        single = single.unionByName(docs.join(repeated, "key", "left_semi").dropDuplicates(["key"]))
    return unnested(single, "doc", ())
