"""Repair of conversation structure by a Viterbi search that emits edits as soon as all survivors agree on them."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.storage import Scratch

# Edits by initial, in ASCII order, and their costs.
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3   # a truncated row that stays
# The states of the form (s?(ua)+)?, named after the role that came last.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ENDS = (START, ASSISTANT)
# Whatever can follow one of these states can follow ASSISTANT at this extra cost at most: one ``s`` deleted, or none.
_BRIDGE = {START: COST[DELETE], SYSTEM: 0}
ROLES = {"u": "user", "a": "assistant"}
SPACES = " \t\n\x0b\x0c\r"

EDITS = ("conv struct<id:{id}>, edit string, fault string, turn {turn}, given_role string, given_text string, role string, text string, "
         "cost long")


class Node:
    """An edit on the way to some survivors. ``refs`` counts the nodes after it and the survivors that end here."""

    __slots__ = ("parent", "edit", "depth", "refs")

    def __init__(self, parent: Node | None, edit: str):
        self.parent, self.edit, self.refs = parent, edit, 0
        self.depth = 0 if parent is None else parent.depth + 1
        if parent is not None:
            parent.refs += 1


def _smaller(a: tuple[Node, str], b: tuple[Node, str]) -> bool:
    """Whether the edits up to a node and one more come before another such row of edits, read from where the two part."""
    (x, last_x), (y, last_y) = a, b
    left, right = [last_x], [last_y]
    while x is not y:
        if x.depth >= y.depth:
            left.append(x.edit)
            x = x.parent
        else:
            right.append(y.edit)
            y = y.parent
    return left[::-1] < right[::-1]


class Survivors:
    """The cheapest edits to every state, of equal ones the ASCII-least, as a tree of backpointers.

    Two rows of edits with one state and one cost are never prefixes of each other, as both hold one edit for each row read and
    a longer one would have more inserts, so the smaller of two stays the smaller whatever follows. A survivor goes when
    ASSISTANT is cheaper by more than it takes to follow it. Edits before the node that all survivors share are final: they are
    emitted, and their nodes are freed, so memory holds only the part on which survivors differ, however long it is.
    """

    def __init__(self) -> None:
        self.base = Node(None, "")
        self.base.refs = 1
        self.alive: dict[int, tuple[int, Node]] = {START: (0, self.base)}

    def _release(self, node: Node | None) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs or node is self.base:
                return
            node = node.parent

    def _inserts(self) -> None:
        """Let survivors go on by inserted turns, as long as that is better for some state."""
        changed = True
        while changed:
            changed = False
            for state in sorted(self.alive):
                cost, node = self.alive[state]
                target, cost = NEXT[state, WANTED[state]], cost + COST[INSERT]
                old = self.alive.get(target)
                if old is None or cost < old[0] or cost == old[0] and _smaller((node, INSERT), (old[1].parent, old[1].edit)):
                    new = Node(node, INSERT)
                    new.refs = 1
                    self.alive[target] = (cost, new)
                    if old is not None:
                        self._release(old[1])
                    changed = True

    def _prune(self) -> None:
        for state, bridge in _BRIDGE.items():
            if state in self.alive and self.alive[state][0] > self.alive[ASSISTANT][0] + bridge:
                self._release(self.alive.pop(state)[1])

    def _shared(self) -> list[str]:
        """Move the base to the last node that all survivors share and return the edits passed."""
        if self.base.refs > 1:
            return []
        way, node = [], next(iter(self.alive.values()))[1]
        while node is not self.base:
            way.append(node)
            node = node.parent
        ends, passed = {id(node) for _, node in self.alive.values()}, []
        while way and self.base.refs == 1 and id(self.base) not in ends:
            self.base = way.pop()
            self.base.parent = None
            passed.append(self.base.edit)
        return passed

    def read(self, initial: str, must_go: bool, truncated: bool) -> list[str]:
        """Read a row and return the edits that are final now."""
        self._inserts()
        self._prune()
        best: dict[int, tuple[int, Node, str]] = {}
        for state, (cost, node) in self.alive.items():
            moves = [(state, COST[DELETE], DELETE)]
            if not must_go:
                extra = TRUNCATED if truncated else 0
                moves.append((NEXT[state, WANTED[state]], COST[REROLE] + extra, REROLE))
                if (state, initial) in NEXT:
                    moves.append((NEXT[state, initial], COST[KEEP] + extra, KEEP))
            for target, more, edit in moves:
                old = best.get(target)
                if old is None or cost + more < old[0] or cost + more == old[0] and _smaller((node, edit), old[1:]):
                    best[target] = (cost + more, node, edit)
        before, self.alive = self.alive, {}
        for state, (cost, node, edit) in best.items():
            new = Node(node, edit)
            new.refs = 1
            self.alive[state] = (cost, new)
        for _, node in before.values():
            self._release(node)
        return self._shared()

    def finish(self) -> list[str]:
        """The rest of the edits."""
        self._inserts()
        best = None
        for state in ENDS:
            if state in self.alive:
                cost, node = self.alive[state]
                if best is None or cost < best[0] or cost == best[0] and _smaller((node.parent, node.edit) if node.parent else (node, ""),
                                                                                 (best[1].parent, best[1].edit) if best[1].parent else (best[1], "")):
                    best = (cost, node)
        node, rest = best[1], []
        while node is not self.base:
            rest.append(node.edit)
            node = node.parent
        return rest[::-1]


def trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def damage(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of conversations, damaged by a hash of conversation and turn: one in 20 dropped, one emptied, one without ``.!?``, one
    given twice, one said by the user. A null role or text is one space."""
    kind = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (id_col, turn_col)]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    out = df.select(F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), kind.alias("kind"),
                    F.when(kind == 4, "user").otherwise(role).alias("role"),
                    F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    return out.filter("kind <> 0").select("conv_id", "turn", "role", "text", F.explode(
        F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repair(scratch: Scratch, df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """The cheapest edits that give each conversation the form (s?(ua)+)? by the initials of its roles: rows (id, edit, fault, turn,
    given_role, given_text, role, text, cost) in order, each conversation in one partition. Deleted rows have a null role and
    text, inserted ones a null turn, given_role and given_text.

    A row's first fault is ``blank``, ``duplicate`` (role and text stood earlier in the conversation) or ``truncated`` (its last
    character that is no white space is none of ``.!?``); blank and duplicate rows must go, at 4 like any deletion. Keep costs 0,
    another role (user or assistant) 3, an inserted empty turn 3, and a truncated row that stays 3. Of equally cheap edits the
    ASCII-least row of initials wins.

    Rows are in order of turn, nulls first, ties by role and text; repeated rows are adjacent, and all but the first are
    duplicates. A null role or text is empty, and an empty role has no initial. Rows with a null id are one conversation. Extra
    columns are ignored, and an empty table has no edits. First places of repeated texts are found by grouped aggregation; a
    conversation streams through one task, because its order is the input, and the task holds the rows that its survivors have
    not agreed on and no others. In random tests that was at most a few dozen rows; ties can make it longer.
    """
    types = {c: df.schema[c].dataType.simpleString() for c in (id_col, turn_col)}
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"),
                     F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256).alias("content"))
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn")
    repeated = scratch.cut(rows.groupBy("id", "content").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
                           .filter("n > 1").select(F.col("id").alias("of"), F.col("content").alias("same"), "first"), "repeated")
    end = F.right(trimmed(F.col("text")), F.lit(1))
    marked = rows.join(repeated, F.col("id").eqNullSafe(F.col("of")) & (F.col("content") == F.col("same")), "left").select(
        "id", "turn", "role", "text", "content", F.coalesce(place > F.col("first"), F.lit(False)).alias("seen"),
        (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("truncated"))
    schema = EDITS.format(id=types[id_col], turn=types[turn_col])
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        size, current, search, held, state, last = 0, None, None, deque(), START, None
        kinds: list = []

        def emit(edits: list[str]) -> None:
            nonlocal size, state
            for edit in edits:
                turn = given = said = fault = None
                cost = COST[edit]
                if edit != INSERT:
                    turn, given, said, fault = held.popleft()
                if edit == DELETE:
                    role = text = None
                else:
                    initial = given[:1] if edit == KEEP else WANTED[state]
                    role, text = (given, said) if edit == KEEP else (ROLES[initial], said or "")
                    state = NEXT[state, initial]
                    cost += TRUNCATED if fault == "truncated" else 0
                for column, value in zip(out, (current[0], edit, fault, turn, given, said, role, text, cost)):
                    column.append(value)
                size += 100 + 2 * len(said or "")

        def flush() -> pa.RecordBatch:
            nonlocal out, size
            conv = pa.StructArray.from_arrays([pa.array(out[0], kinds[0])], names=["id"])
            arrays = [conv, *[pa.array(c, k) for c, k in zip(out[1:], (pa.string(), pa.string(), kinds[1], *[pa.string()] * 4, pa.int64()))]]
            out, size = [[] for _ in names], 0
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            kinds = [batch.schema.field(0).type, batch.schema.field(1).type]
            for conv, turn, role, text, content, seen, blank, truncated in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or current[0] != conv:
                    if current is not None:
                        emit(search.finish())
                    current, search, state, last = (conv,), Survivors(), START, None
                fault = "blank" if blank else "duplicate" if seen or last == (turn, content) else "truncated" if truncated else None
                last = (turn, content)
                held.append((turn, role, text, fault))
                emit(search.read(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
                if size > 1 << 22:
                    yield flush()
        if current is not None:
            emit(search.finish())
        if out[0]:
            yield flush()

    ordered = marked.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    return ordered.mapInArrow(run, schema).select("conv.id", *names[1:])


def digests(edits: DataFrame, id_name: str) -> DataFrame:
    """Per conversation, read from its edits: (id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)."""
    id_type = edits.schema["id"].dataType.simpleString()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = f"c struct<id:{id_type}>, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        done: list = []
        current = None

        def begin(conv) -> dict:
            return {"id": conv, **dict.fromkeys(counts, 0), "low": None, "high": None, "distinct": 0, "role": None, "audit": [],
                    "hash": sha256(), "rows": 0}

        def end(c: dict) -> tuple:
            gaps = 0 if c["low"] is None else c["high"] - c["low"] + 1 - c["distinct"]
            return (c["id"], gaps, *[c[k] for k in counts[1:]], "".join(c["audit"]), c["hash"].hexdigest())

        def batch_of(rows: list, kind) -> pa.RecordBatch:
            conv = pa.StructArray.from_arrays([pa.array([r[0] for r in rows], kind)], names=["id"])
            return pa.RecordBatch.from_arrays(
                [conv, *[pa.array([r[i + 1] for r in rows], pa.int64()) for i in range(len(counts))],
                 *[pa.array([r[i] for r in rows], pa.string()) for i in (-2, -1)]], names=["c", *counts, "audit", "repaired_sha256"])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, edit, fault, turn, given, role, text, cost in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or current["id"] != conv:
                    if current is not None:
                        done.append(end(current))
                    current = begin(conv)
                c = current
                c["audit"].append(edit)
                c["cost"] += cost
                if fault is not None:
                    c[fault] += 1
                if given is not None:
                    if c["role"] is not None and c["role"] + given[:1] not in ("su", "ua", "au"):
                        c["illegal"] += 1
                    c["role"] = given[:1]
                    if turn is not None and turn != c["high"]:   # turns ascend
                        c["low"] = turn if c["low"] is None else c["low"]
                        c["high"], c["distinct"] = turn, c["distinct"] + 1
                if role is not None:
                    c["hash"].update((("\n" if c["rows"] else "") + f"{role}:{text}").encode())
                    c["rows"] += 1
            if len(done) > 1000:
                yield batch_of(done, kind)
                done = []
        if current is not None:
            done.append(end(current))
        if done:
            yield batch_of(done, kind)

    return edits.select("id", "edit", "fault", "turn", "given_role", "role", "text", "cost").mapInArrow(run, schema).select(
        F.col("c.id").alias(id_name), *counts, "audit", "repaired_sha256")
