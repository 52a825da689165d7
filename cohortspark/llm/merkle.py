"""Merkle manifest of a dataset: a digest for every row, one root, and a proof for every row by descent from the root.

Rows of one group are the leaves of a tree in id order; the groups' roots are the leaves of a last tree. The store holds
digest-to-children records. Records are written in *packs*: the part of a tree between a node and the nodes ``LEVELS`` levels
below it, kept under the digest of its upper node. So a tree of any size is built, and descended, in a few passes, and no task
holds more than one pack of a node and its at most ``FAN ** LEVELS`` lower ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.rows import prefix_sums
from cohortspark.storage import Scratch

# Fixed values of the tree's shape.
FAN_BITS = 3                # 8 children
LEVELS = 4                  # levels of a pack
PACK_BITS = FAN_BITS * LEVELS
FAN = 1 << FAN_BITS

_PATH = "array<struct<before:string,after:string>>"
_PACK = "tree long, pack long, m long, digest string, records array<struct<digest:string,children:array<string>>>"


def digest_of(*columns: Column) -> Column:
    """SHA-256 of the columns in order: ``-`` for a null, else the value's length in bytes, ``:`` and the value."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """The digests of a proof, from the leaf's level to the root's and from left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def levels_of(m: int) -> int:
    """How many levels a pack has above m nodes of a whole tree level."""
    levels = 0
    while levels < LEVELS and m > 1:
        m, levels = -(-m // FAN), levels + 1
    return levels


def fold(digests: list[str], levels: int) -> tuple[str, list[tuple[str, list[str]]]]:
    """The upper node of a pack and its records."""
    from hashlib import sha256

    records = []
    for _ in range(levels):
        runs = [digests[i:i + FAN] for i in range(0, len(digests), FAN)]
        digests = [sha256("".join(run).encode()).hexdigest() for run in runs]
        records += zip(digests, runs)
    return digests[0], records


def descend(top: str, path: list, records: Mapping[str, list[str]], levels: int, ranks: Iterable[int]) -> Iterator[tuple[str, list]]:
    """For each rank below a pack's upper node: the digest there, and the path from the root, the root's level first. Requests that
    begin with the same digits walk together."""
    known = {(0, 0): (top, path)}

    def at(depth: int, prefix: int) -> tuple[str, list]:
        found = known.get((depth, prefix))
        if found is None:
            digest, above = at(depth - 1, prefix >> FAN_BITS)
            children, i = records[digest], prefix & FAN - 1
            found = known[depth, prefix] = (children[i], [*above, ("".join(children[:i]), "".join(children[i + 1:]))])
        return found

    for rank in ranks:
        yield at(levels, rank & (1 << FAN_BITS * levels) - 1)


def _packed(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, rank, m, digest) of one level, m being their number in the tree, as packs."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(packs: list) -> pa.RecordBatch:
            made = [(*key, *fold(digests, levels_of(key[2]))) for key, digests in packs]
            records = pa.array([[{"digest": d, "children": c} for d, c in row[4]] for row in made],
                               pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))])))
            return pa.RecordBatch.from_arrays([*[pa.array([row[i] for row in made], pa.int64()) for i in range(3)],
                                               pa.array([row[3] for row in made], pa.string()), records],
                                              names=["tree", "pack", "m", "digest", "records"])

        ready: list = []
        held = 0
        for batch in batches:
            for *key, digest in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if not ready or ready[-1][0] != key:
                    if held >= 1 << PACK_BITS:
                        yield finish(ready)
                        ready, held = [], 0
                    ready.append((key, []))
                ready[-1][1].append(digest)
                held += 1
        if ready:
            yield finish(ready)

    placed = nodes.select("tree", F.shiftright("rank", PACK_BITS).alias("pack"), "m", "rank", "digest")
    return placed.repartition("tree", "pack").sortWithinPartitions("tree", "pack", "rank").mapInArrow(run, _PACK)


def _grown(scratch: Scratch, leaves: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """The packs of each pass and the roots (tree, digest) of all trees over leaves (tree, rank, m, digest)."""
    passes, nodes = [], leaves
    roots = nodes.filter("m = 1").select("tree", "digest")
    while largest > 1:
        packs = scratch.cut(_packed(nodes.filter("m > 1")), "packs")
        passes.append(packs)
        nodes = packs.select("tree", F.col("pack").alias("rank"), (F.shiftright(F.col("m") - 1, PACK_BITS) + 1).alias("m"), "digest")
        roots = roots.unionByName(nodes.filter("m = 1").select("tree", "digest"))
        largest = (largest - 1 >> PACK_BITS) + 1
    return passes, roots


def _nodes_at(n: Column, level: int) -> Column:
    """How many nodes a tree of n leaves has after so many passes."""
    return F.shiftright(n - 1, PACK_BITS * level) + 1


def _found(here: DataFrame, wanted: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Wanted rows (tree, pack, rank, carried columns) with the digest at their rank and the path down to it."""
    types = dict(wanted.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in ("tree", "pack", "rank", *carried)] + [f"digest string, path {_PATH}"])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        digests, befores, afters, offsets = [], [], [], [0]
        if right.num_rows:
            top, m, path, records = (left.column(c)[0].as_py() for c in ("digest", "m", "path", "records"))
            store = {r["digest"]: r["children"] for r in records}
            for digest, steps in descend(top, [(s["before"], s["after"]) for s in path], store, levels_of(m), right.column("rank").to_pylist()):
                digests.append(digest)
                befores += [s[0] for s in steps]
                afters += [s[1] for s in steps]
                offsets.append(len(befores))
        steps = pa.StructArray.from_arrays([pa.array(befores, pa.string()), pa.array(afters, pa.string())], names=["before", "after"])
        return (right.select(["tree", "pack", "rank", *carried]).append_column("digest", pa.array(digests, pa.string()))
                .append_column("path", pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)))

    key = ("tree", "pack")
    return here.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInArrow(run, schema)


def _descent(scratch: Scratch, roots: DataFrame, passes: list[DataFrame], requests: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Requests (tree, rank, n, carried) with the digest they end at and the path to it, the root's level first. ``roots`` are
    (tree, n, digest, path): where each tree's descent begins."""
    frontier = None
    for level in reversed(range(len(passes))):
        start = roots.filter((_nodes_at(F.col("n"), level) > 1) & (_nodes_at(F.col("n"), level + 1) == 1)).select(
            "tree", F.lit(0).cast("long").alias("pack"), "digest", "path")
        reached = start if frontier is None else start.unionByName(frontier)
        # Equal subtrees have equal digests and are kept once.
        store = passes[level].select("digest", "m", "records").dropDuplicates(["digest"])
        below = requests.filter(_nodes_at(F.col("n"), level) > 1).withColumn("rank", F.shiftright("rank", PACK_BITS * level))
        wanted = below.select("tree", F.shiftright("rank", PACK_BITS).alias("pack"), "rank", *(carried if not level else ()))
        # The height of a pack follows from its own tree, as equal packs can stand in trees of other sizes.
        found = _found(reached.join(store.drop("m"), "digest").join(roots.select("tree", _nodes_at(F.col("n"), level).alias("m")), "tree"),
                       wanted if not level else wanted.distinct(), carried if not level else ())
        if level:
            frontier = scratch.cut(found.select("tree", F.col("rank").alias("pack"), "digest", "path"), "frontier")
    lone = requests.filter("n = 1").join(roots.select("tree", "digest", "path"), "tree").select("tree", "rank", *carried, "digest", "path")
    return lone if not passes else found.select("tree", "rank", *carried, "digest", "path").unionByName(lone)


@dataclass
class Manifest:
    """``root`` (None for an empty table), ``leaves`` (group, id, leaf, tree, rank, n, carried columns), ``groups`` (group, tree, n,
    subroot, path) and the ``records`` (digest, children) of all inner nodes."""

    scratch: Scratch
    root: str | None
    leaves: DataFrame
    groups: DataFrame
    passes: list[DataFrame]
    top_passes: list[DataFrame]
    carried: list[str]

    @property
    def records(self) -> DataFrame:
        packs = [p.select(F.explode("records").alias("r")).select("r.digest", "r.children") for p in (*self.passes, *self.top_passes)]
        out = self.groups.sparkSession.createDataFrame([], "digest string, children array<string>")
        for p in packs:
            out = out.unionByName(p)
        return out.dropDuplicates(["digest"])

    def proofs(self, ids: DataFrame | None = None) -> DataFrame:
        """Per leaf (all, or those whose id is in the one column of ``ids``): id, leaf, subroot, root, path, carried columns.
        ``path`` has the siblings before and after the leaf's ancestor on each level, the leaf's own first."""
        asked = self.leaves if ids is None else self.leaves.join(ids.toDF("asked").distinct(), F.col("id").eqNullSafe(F.col("asked")), "left_semi")
        roots = self.groups.select("tree", "n", F.col("subroot").alias("digest"), "path")
        found = _descent(self.scratch, roots, self.passes, asked.drop("group"), ["id", "leaf", *self.carried])
        return found.join(self.groups.select("tree", "subroot"), "tree").select(
            "id", "leaf", "subroot", F.lit(self.root).alias("root"), F.reverse("path").alias("path"), *self.carried)


def build(scratch: Scratch, df: DataFrame, leaf: Column, id_col: str = "doc_id", group_col: str = "lang",
          carry: Mapping[str, Column] | None = None) -> Manifest:
    """The manifest of a table. ``leaf`` is a row's digest and ``carry`` names more columns to keep beside it (short ones: they are
    shuffled). The table is read once, and only digests, ids and groups move.

    Leaves of a group stand in id order, nulls first, ties by digest; groups in order of their UTF-8 bytes, null first. Every 8
    consecutive nodes of a level, or what is left of them at its end, become their parent until one node remains; a lone leaf
    is its group's root. Repeated rows are leaves of their own, with equal digests. An empty table has no root and no leaves.
    A group that holds most rows spreads over many tasks: ranks come from a range sort over all rows, and packs are grouped by
    tree and rank. Nothing but the number of leaves of the largest tree and the root reaches the driver.
    """
    carry = dict(carry or {})
    named = scratch.cut(df.select(F.col(f"`{group_col}`").alias("group"), F.col(f"`{id_col}`").alias("id"), leaf.alias("leaf"),
                                  F.monotonically_increasing_id().alias("row"), F.lit(1).cast("long").alias("one"),
                                  *[c.alias(n) for n, c in carry.items()]), "leaves")
    placed = prefix_sums(scratch, named, ["group", "id", "leaf", "row"], ["one"])
    counted = scratch.cut(placed.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("before_one").alias("first"))
                          .withColumn("one", F.lit(1).cast("long")), "groups")
    trees = prefix_sums(scratch, counted, ["group"], ["one"]).select("group", "n", "first", F.col("before_one").alias("tree"))
    leaves = placed.join(trees.withColumnRenamed("group", "of"), F.col("group").eqNullSafe(F.col("of"))).select(
        "group", "id", "leaf", "tree", (F.col("before_one") - F.col("first")).alias("rank"), "n", *carry)
    total, largest = trees.agg(F.count(F.lit(1)), F.max("n")).first()

    passes, subroots = _grown(scratch, leaves.select("tree", "rank", F.col("n").alias("m"), F.col("leaf").alias("digest")), largest or 0)
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.lit(total).cast("long").alias("m"), "digest")
    top_passes, roots = _grown(scratch, tops, total)
    first = roots.first()
    root = first["digest"] if first else None
    start = df.sparkSession.createDataFrame([(0, total, root, [])], f"tree long, n long, digest string, path {_PATH}").filter("digest IS NOT NULL")
    requests = tops.select("tree", "rank", F.col("m").alias("n"))
    paths = _descent(scratch, start, top_passes, requests, []).select(F.col("rank").alias("tree"), F.col("digest").alias("subroot"), "path")
    groups = scratch.cut(trees.select("group", "tree", "n").join(paths, "tree"), "paths")
    return Manifest(scratch, root, leaves, groups, passes, top_passes, list(carry))
