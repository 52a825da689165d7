"""Contextual extraction without Spark: patterns, graph scores and added spans of a few texts, one step after the other."""

from __future__ import annotations

from collections import defaultdict
from math import prod

from cohortspark.llm import pii


def opened_patterns(texts, min_seeds, min_pattern):
    """Patterns whose slots hold mostly seeds."""
    seeds, fillers = defaultdict(set), defaultdict(set)
    for text in texts:
        for i, j, patterns in pii.seed_spans(text, pii.base_spans(text)):
            for p in patterns:
                seeds[p].add(text[i:j])
    induced = {p for p, values in seeds.items() if len(values) >= min_seeds}
    for text in texts:
        for i, j, p in pii.Slots(induced).fillers(text, pii.base_spans(text)):
            fillers[p].add(text[i:j])
    return {p for p in induced if len(seeds[p]) >= min_pattern * (len(seeds[p]) + len(fillers[p]) + 1)}


def added_spans(texts, rounds=3, min_seeds=3, min_pattern=0.6, min_instance=0.7, min_chars=6, min_digits=4):
    """For each text the (start, stop) that the method adds, by start."""
    opened = opened_patterns(texts, min_seeds, min_pattern)
    occurrences = [pii.candidates(t, pii.base_spans(t), min_chars, min_digits, pii.Slots(opened)) for t in texts]
    members, seeds = defaultdict(set), set()   # pattern -> instances
    for text, found in zip(texts, occurrences):
        for i, j, seed, patterns in found:
            if seed:
                seeds.add(text[i:j])
            for p in patterns:
                members[p].add(text[i:j])
    patterns_of = defaultdict(set)
    for p, values in members.items():
        for v in values:
            patterns_of[v].add(p)
    trust = {v: float(v in seeds) for v in patterns_of}
    for _ in range(rounds):
        scores = {}
        for p, values in members.items():
            if sum(trust[v] >= min_instance for v in values) >= min_seeds:
                score = sum(trust[v] for v in values) / (len(values) + 1)
                if score >= min_pattern:
                    scores[p] = score
        trust = {v: 1.0 if v in seeds else 1 - prod(1 - scores[p] for p in own if p in scores) for v, own in patterns_of.items()}
    out = []
    for text, found in zip(texts, occurrences):
        spans, end = [], 0
        for i, j in sorted({(i, j) for i, j, seed, patterns in found if not seed and trust[text[i:j]] >= min_instance
                            and any(p in scores for p in patterns)}, key=lambda s: (s[0], -s[1])):
            if i >= end:
                spans.append((i, j))
                end = j
        out.append(spans)
    return out
