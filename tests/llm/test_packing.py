from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortspark.llm import packing, tokens

TEXTS = ["", None, "one", "a b c " * 40, "x" * 5000, "é漢字\U0001F600 " * 300, "<|endoftext|> stays text", "word " * 3000, " \n\t "]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_rank_file_gives_the_tokenizers_ids(spark, tokenizer):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    encode = tokens.encoder(tokens.default_ranks())
    for text in [*texts, *(t or "" for t in TEXTS), "a" * 100_000, " " * 100_000, "\x85\x1c　 ﻿x"]:
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def check_pack(rows, docs, tokenizer, limit=1024):
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r["id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    for doc_id, text in docs.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(pieces[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert b"".join(bytes(r["ids"]) for r in own) == np.array(ids, "<u4").tobytes()
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert all(r["length"] == limit for r in own[1:]) and own[0]["length"] <= limit
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= limit
    return len(seqs), -(-sum(r["length"] for r in rows) // limit)


def test_pieces_and_places(scratch, docs_of, tokenizer):
    docs = dict(enumerate(TEXTS * 3))
    df = docs_of(list(docs.items())).withColumnRenamed("n_chars", "length").repartition(5)
    packed = packing.pack(scratch, df)
    used, bound = check_pack(packed.collect(), docs, tokenizer)
    assert used <= bound + 1
    whole = packing.sequences(packed).collect()
    assert len(whole) == used and all(len(r["ids"]) <= 4096 for r in whole)


def test_corpus_is_packed_close_to_the_bound(spark, scratch, tokenizer):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in df.collect()}
    rows = packing.pack(scratch, df).collect()
    used, bound = check_pack(rows, docs, tokenizer)
    large = sum(r["length"] > 512 for r in rows)
    assert used <= max(bound, large) + 2
    assert all(zlib.crc32(bytes(r["ids"])) >= 0 for r in rows)


def brute_bins(items, limit):
    """The fewest bins, by trying everything."""
    best = [len(items)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms)}.values():
            if rooms[i] >= items[k]:
                place(k + 1, [*rooms[:i], rooms[i] - items[k], *rooms[i + 1:]])
        place(k + 1, [*rooms, limit - items[k]])

    place(0, [])
    return best[0]


def test_plan_is_optimal_on_small_cases():
    r = random.Random(4)
    for _ in range(40):
        items = sorted((r.randint(1, 30) for _ in range(r.randint(1, 9))), reverse=True)
        histogram = {x: items.count(x) for x in items}
        patterns = packing.plan(histogram, 30)
        used = {}
        for pattern, times in patterns:
            assert sum(a * b for a, b in pattern) <= 30
            for length, n in pattern:
                used[length] = used.get(length, 0) + n * times
        assert used == histogram
        assert sum(times for _, times in patterns) == brute_bins(items, 30)


def brute_dominates(rooms, items):
    if not items:
        return True
    return any(room >= items[0] and brute_dominates([*rooms[:i], room - items[0], *rooms[i + 1:]], items[1:]) for i, room in enumerate(rooms))


def test_dominance_shares_out_the_pieces():
    assert not packing.dominates(((99, 1), (1, 1)), ((50, 2),)) and packing.dominates(((99, 1), (1, 1)), ((50, 1), (49, 1), (1, 1)))
    r = random.Random(6)
    tally = lambda items: tuple((x, items.count(x)) for x in sorted(set(items), reverse=True))
    for _ in range(3000):
        rooms, items = ([r.randint(1, 12) for _ in range(r.randint(0, 4))] for _ in range(2))
        assert packing.dominates(tally(rooms), tally(items)) == brute_dominates(rooms, items), (rooms, items)


def test_fillings_are_the_undominated_ones():
    r = random.Random(2)
    for _ in range(150):
        counts = [0] * 13
        for _ in range(r.randint(1, 5)):
            counts[r.randint(1, 12)] += 1
        lengths, room = [n for n in range(12, 0, -1) if counts[n]], 12
        ways = [w for w in itertools.product(*[range(counts[n] + 1) for n in lengths]) if sum(k * n for k, n in zip(w, lengths)) <= room]
        full = [[n for k, n in zip(w, lengths) for _ in range(k)] for w in ways]
        found = [[n for n, k in f for _ in range(k)] for f in packing._fillings(counts, lengths, room, room, 10_000, 10_000)]
        assert all(any(brute_dominates(f, way) for f in found) for way in full)      # nothing undominated is missing
        assert not any(f is not g and brute_dominates(f, g) for f in found for g in found)


def test_plan_has_a_few_patterns_a_length():
    r = random.Random(5)
    for low, high, number in ((1, 1024, 100_000), (1, 60, 50_000), (250, 700, 5_000)):
        items = [r.randint(low, high) for _ in range(number)]
        patterns = packing.plan({x: items.count(x) for x in set(items)}, 1024, nodes=50)
        assert len(patterns) <= 3 * (high - low + 1) + 320 and len({p for p, _ in patterns}) == len(patterns)


def test_ids_are_not_shuffled_and_tasks_go_in_groups(scratch, docs_of, tokenizer, monkeypatch):
    docs = {i: TEXTS[i % len(TEXTS)] for i in range(60)}
    df = docs_of(list(docs.items())).repartition(7)
    for tasks in (packing.TASKS, 3):
        monkeypatch.setattr(packing, "TASKS", tasks)
        packed = packing.pack(scratch, df)
        plan = packed._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
        check_pack(packed.collect(), docs, tokenizer)


def test_empty_and_repeated_rows(scratch, docs_of):
    assert packing.pack(scratch, docs_of([])).count() == 0
    rows = packing.pack(scratch, docs_of([(None, None), (1, "same"), (1, "same")])).collect()
    assert len(rows) == 3 and len({r["sequence_id"] for r in rows}) == 1


ADDED_TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x  <|endoftext|>\n\n y", "<|endoftext|", "é<|endoftext|>漢 <|endoftext",
               "<|endo<|endoftext|>text|>", "", "no such token", "word " * 1500 + "<|endoftext|>" * 700, "it's <|endoftext|>'s 12<|endoftext|>34"]


def test_added_token_has_the_ids_of_the_json_file(spark, docs_of, tmp_path):
    import corpus_pipeline
    from cohortspark.llm import queries

    json_file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))   # as it is
    encode = tokens.encoder(tokens.default_ranks(), tokens.ADDED)
    r = random.Random(7)
    mixed = ["".join(r.choice(["<|endoftext|>", " ", "a", "\n", "<|", "|>", "1", "é", "'s"]) for _ in range(r.randint(0, 9))) for _ in range(2000)]
    for text in [*ADDED_TEXTS, *mixed]:
        assert encode(text) == json_file.encode(text, add_special_tokens=False).ids
    docs = docs_of(list(enumerate(ADDED_TEXTS)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    expected = set()
    for i, text in enumerate(ADDED_TEXTS):
        ids = [*json_file.encode(text, add_special_tokens=False).ids, 2]
        cut = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        expected |= {(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cut, cut[1:]))}
    for packed in (queries.op5_packing(spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))):
        assert {(x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in packed.collect()} == expected
