from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cohortspark.llm import simhash
from cohortspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute_print(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_groups(values, bits=4):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def corpus():
    r = random.Random(5)
    vocabulary = ["Alpha", "beta", "É", "漢", "x\x1cy", "gamma\x85", "DELTA"] + [f"w{i}" for i in range(200)]
    rows = [(100, None), (99, ""), (98, " \n"), (97, "one"), (96, "One"), (95, "a b c d"), (94, "a  b\tc\nD")]
    for k in range(25):
        words = [r.choice(vocabulary) for _ in range(r.choice([3, 5, 30, 400]))]
        rows.append((k, " ".join(words)))
        for c in range(r.randint(0, 3)):
            copy = list(words)
            copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((200 + 4 * k + c, "  ".join(copy)))
    rows.append((500, "long " * 70_001))
    return rows


def test_fingerprints_and_components(scratch, docs_of):
    data = corpus()
    rows = {r["id"]: r for r in simhash.near_dedup(scratch, docs_of(data)).collect()}
    values = [brute_print(t) for _, t in data]
    groups = brute_groups(values)
    for k, (doc_id, _) in enumerate(data):
        assert rows[doc_id]["fingerprint"] == f"{values[k]:016x}"
        assert rows[doc_id]["component_id"] == min(d for j, (d, _) in enumerate(data) if groups[j] == groups[k])


def test_links_reach_what_all_pairs_reach(spark, scratch):
    r = random.Random(6)
    values = {r.getrandbits(64) for _ in range(200)}
    for width in (64, 20, 9):   # loose, dense and very dense balls, with long chains
        centre = r.getrandbits(64)
        for _ in range(150):
            v = centre
            for _ in range(r.randint(0, 6)):
                v ^= 1 << r.randrange(width)
            values.add(v)
    values = sorted(values)
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    for bits, limit in ((4, 2048), (4, 8), (3, 8)):   # small buckets force the finer levels
        groups = brute_groups(values, bits)
        found = simhash.links(scratch, spark.createDataFrame(signed, "p long"), "p", bits, limit)
        labels = {x["node"]: x["label"] for x in components(scratch, found).collect()}
        own = [labels.get(s[0], s[0]) for s in signed]
        assert len({*zip(groups, own)}) == len(set(groups)) == len(set(own))


def test_components_of_chains_and_stars(spark, scratch):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(1, 1), (200, 201), (201, 200)]
    labels = {r["node"]: r["label"] for r in components(scratch, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert labels == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 60)}, 200: 200, 201: 200}
    assert components(scratch, spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(scratch, docs_of):
    data = [*corpus(), (3, "same words here again and again"), (3, "same words here again and again"), (None, "no id at all"),
            (None, "no id at all"), (4, "same words here again and again")]
    df = docs_of(data).withColumn("key", F.lit(1)).withColumn("Component", F.lit("c"))
    kept = simhash.drop_near_duplicates(scratch, df)
    assert kept.columns == df.columns
    rows = kept.collect()
    values = [brute_print(t) for _, t in data]
    groups = brute_groups(values)
    assert len(rows) == len(set(groups))
    index = {(d, t): groups[k] for k, (d, t) in enumerate(data)}
    assert {index[r["doc_id"], r["text"]] for r in rows} == set(groups)
    assert simhash.drop_near_duplicates(scratch, docs_of([])).count() == 0
