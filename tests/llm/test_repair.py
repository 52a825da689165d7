from __future__ import annotations

import itertools
import random
import re
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cohortspark.llm import repair
from cohortspark.llm.queries import op12_repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
FORM = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def faults(rows):
    out, seen = [], set()
    for _, turn, role, text in rows:
        end = text.strip(SPACE)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
        seen.add((role, text))
    return out


def enumerated(rows, marks, inserts):
    """All edits (of few rows) with up to so many inserts before each row and at the end; the cheapest, of equal ones the least."""
    best = None
    ways = ["", "I", "II", "III"][:inserts + 1]
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(m in ("blank", "duplicate") and e != "D" for e, m in zip(edits, marks)):
            continue
        cost = sum({"D": 4, "K": 0, "R": 3}[e] + (3 if m == "truncated" and e != "D" else 0) for e, m in zip(edits, marks))
        for gaps in itertools.product(ways, repeat=len(rows) + 1):
            total = cost + 3 * sum(map(len, gaps))
            audit = "".join(g + e for g, e in zip(gaps, edits)) + gaps[-1]
            if best is not None and (total, audit) >= best[:2]:
                continue
            options = [[r[2][:1] or "?"] if e == "K" else ["u", "a"] for e, r in walk(audit, rows) if e != "D"]
            for roles in itertools.product(*options):
                if FORM.match("".join(roles)):
                    best = (total, audit, roles)
                    break
    return best


def walk(audit, rows):
    left = iter(rows)
    return [(e, None if e == "I" else next(left)) for e in audit]


def whole(rows, marks):
    """The same by a table of whole strings, for long conversations."""
    states = {0: (0, "")}

    def closed(t):
        for _ in range(3):
            for s, (c, a) in list(t.items()):
                n = {0: 2, 1: 2, 2: 3, 3: 2}[s]
                t[n] = min(t.get(n, (c + 3, a + "I")), (c + 3, a + "I"))
        return t

    for (_, _, role, _), m in zip(rows, marks):
        new = {}
        for s, (c, a) in closed(states).items():
            moves = [(s, 4, "D")]
            if m not in ("blank", "duplicate"):
                extra = 3 if m == "truncated" else 0
                moves.append(({0: 2, 1: 2, 2: 3, 3: 2}[s], 3 + extra, "R"))
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, role[:1]))
                if kept:
                    moves.append((kept, extra, "K"))
            for t, more, e in moves:
                new[t] = min(new.get(t, (c + more, a + e)), (c + more, a + e))
        states = new
    closed(states)
    return min(states[s] for s in (0, 3) if s in states)


def rebuilt(audit, rows):
    out, last = [], ""
    for e, row in walk(audit, rows):
        if e == "D":
            continue
        role = row[2] if e == "K" else "assistant" if last == "u" else "user"
        out.append(f"{role}:{'' if e == 'I' else row[3]}")
        last = role[:1]
    return out


def expected(rows):
    """The row of the query for the damaged rows of one conversation."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    marks = faults(rows)
    cost, audit = whole(rows, marks)
    turns = [r[1] for r in rows if r[1] is not None]
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[marks.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha256("\n".join(rebuilt(audit, rows)).encode()).hexdigest())


def searched(symbols):
    search, out, longest, done = repair.Survivors(), [], 0, 0
    for n, (initial, mark) in enumerate(symbols, 1):
        final = search.read(initial, mark in ("blank", "duplicate"), mark == "truncated")
        out += final
        done += sum(e != "I" for e in final)
        longest = max(longest, n - done)
    return "".join(out + search.finish()), longest


def test_search_matches_enumeration_of_all_edits():
    rng = random.Random(1)
    for n in range(5):
        for _ in range(40 if n < 4 else 8):
            rows = [(0, i, rng.choice(["system", "user", "assistant", "assistant", "tool", ""]), f"t{i}.") for i in range(n)]
            marks = [rng.choice([None, None, "blank", "truncated"]) for _ in rows]
            cost, audit, _ = enumerated(rows, marks, 3 if n < 3 else 2 if n < 4 else 1)
            assert searched([(r[2][:1], m) for r, m in zip(rows, marks)])[0] == audit
            assert whole(rows, marks) == (cost, audit)


def test_search_matches_whole_strings_and_agrees_early():
    rng = random.Random(2)
    longest = 0
    for _ in range(1500):
        roles = rng.choice(["ua", "uas", "aaau", "uuua", "sx", "uasx", "a", "u"])
        rows = [(0, i, rng.choice(roles), "") for i in range(rng.randint(0, 60))]
        bad = rng.choice([0.0, 0.1, 0.5, 0.9])
        marks = [rng.choice(["blank", "truncated"]) if rng.random() < bad else None for _ in rows]
        audit, open_rows = searched([(r[2], m) for r, m in zip(rows, marks)])
        assert audit == whole(rows, marks)[1]
        longest = max(longest, open_rows)
    long = [(rng.choice("uuuaaasx"), rng.choice([None, None, None, "blank", "truncated"])) for _ in range(100_000)]
    assert searched(long)[1] <= 40 and longest <= 60


def test_counts_of_references_free_what_no_survivor_needs():
    search = repair.Survivors()
    rng = random.Random(3)
    for _ in range(3000):
        search.read(rng.choice("uasx"), rng.random() < 0.2, rng.random() < 0.2)
        ways = set()
        for _, node in search.alive.values():
            while node is not search.base:
                ways.add(node)
                node = node.parent
        assert all(n.refs == sum(m.parent is n for m in ways) + sum(s is n for _, s in search.alive.values()) for n in ways)


NASTY = ["Yes.", "No", "Yes.", " ", "", None, "line\nline!", "end? \n", "end.\u2028", "\u00a0", "x" * 100_000 + "."]


def conversations():
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "Xer"]), rng.choice(NASTY))
            for c in range(150) for t in range(rng.randint(1, 12)) if rng.random() < 0.9]
    rows += [(None, t, "user", f"q{t}.") for t in range(40)] + [(None, None, "assistant", "a."), (None, None, "assistant", "a.")]
    rows += [(900, None, "user", "x."), (900, 5, "user", "x."), (900, 5, "assistant", "y."), (900, 9, "user", "x."), (900, 9, "user", "x.")]
    rows += [(901, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(0, 800)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("conversations"))
    df = spark.createDataFrame(conversations(), SCHEMA).withColumn("id", F.lit(1)).withColumn("Edit", F.lit("x"))
    df.repartition(6).write.parquet(f"{path}/conversations.parquet")
    return path


def test_query_matches_brute_force(spark, folder):
    rows = conversations()
    after = damaged(rows)
    found = {r["conv_id"]: tuple(r)[1:] for r in op12_repair(spark, folder).collect()}
    assert set(found) == {r[0] for r in rows}
    for conv, got in found.items():
        assert got == expected([r for r in after if r[0] == conv]), conv


def test_repaired_rows_have_the_form(spark, scratch):
    df = spark.createDataFrame([r for r in conversations() if r[2] is not None], SCHEMA)
    edits = repair.repair(scratch, df).collect()
    assert sum(r["edit"] != "I" for r in edits) == df.count()
    by_conv = {}
    for r in edits:
        by_conv.setdefault(r["id"], []).append(r)
    for own in by_conv.values():
        assert FORM.match("".join(r["role"][:1] for r in own if r["edit"] != "D"))
        assert all(r["text"] == "" and r["turn"] is None for r in own if r["edit"] == "I")
        assert all(r["role"] is None and r["text"] is None for r in own if r["edit"] == "D")
        assert all((r["given_role"], r["given_text"]) == (r["role"], r["text"]) for r in own if r["edit"] == "K")


def test_all_rows_dropped_and_empty_table(spark, scratch, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA).write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert [tuple(r) for r in op12_repair(spark, f"{tmp_path}/a").collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert op12_repair(spark, f"{tmp_path}/b").count() == 0
