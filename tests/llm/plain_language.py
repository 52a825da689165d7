"""Language identification once more, row by row in plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from cohortspark.llm.language import visible

BUCKETS = 1 << 15


def buckets(text):
    letters = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in (text or "").lower().encode())
    letters = re.sub(rb" +", b" ", letters)
    if len(letters) < 3 or not letters.strip():
        return []
    return [(((a << 16 | b << 8 | c) * 2654435761) % 2 ** 32) >> 17 for a, b, c in zip(letters, letters[1:], letters[2:])]


def fitted(labelled):
    """{language: [log P(bucket)]}, with a uniform model for what is in no language. For few texts, which are all in the sample."""
    counts = defaultdict(Counter)
    for lang, text in {(lang, text) for lang, text in labelled if lang is not None and text is not None}:
        counts[lang].update(buckets(text))
    model = {}
    for lang in sorted(counts):
        total = sum(counts[lang].values()) + 0.5 * BUCKETS
        model[lang] = [math.log((counts[lang][b] + 0.5) / total) for b in range(BUCKETS)]
    return {**{lang: m for lang, m in model.items() if counts[lang]}, "und": [-math.log(BUCKETS)] * BUCKETS}


def identified(rows, model, strength=40, alpha=0.5, kappa=4.0, least=0.5):
    """(lang, posterior, text_lang, rejected) of each row (text, declared, host, domain, suffix)."""
    names = list(model)
    logs, guesses = [], []
    for text, *_ in rows:
        found = buckets(text)
        scale = min(len(found), strength) / len(found) if found else 0
        logs.append([scale * sum(model[lang][b] for b in found) for lang in names] if found else None)
        guesses.append(max(range(len(names)), key=lambda i: (logs[-1][i], -i)) if found else None)
    read = [(row, g) for row, g in zip(rows, guesses) if g is not None]
    overall = Counter(g for _, g in read)
    base = [(overall[i] + 1) / (len(read) + len(names)) for i in range(len(names))]

    by_host, by_domain = defaultdict(Counter), defaultdict(Counter)
    for (_, _, host, domain, _), g in read:
        if host is not None:
            by_host[host, domain][g] += 1
            by_domain[domain][g] += 1

    def smoothed(counts, towards):
        return [(counts[i] + kappa * towards[i]) / (sum(counts.values()) + kappa) for i in range(len(names))]

    def evidence(place):
        counts = defaultdict(Counter)
        for row, g in read:
            if row[place] is not None:
                counts[row[place]][g] += 1
        totals = [sum(c[i] for c in counts.values()) for i in range(len(names))]
        return {value: [math.log((c[i] + alpha) / (totals[i] + alpha * max(1, len(counts)))) for i in range(len(names))] for value, c in counts.items()}

    declared_logs, suffix_logs, nothing = evidence(1), evidence(4), [0.0] * len(names)
    out = []
    for row, text_logs, g in zip(rows, logs, guesses):
        if text_logs is None:
            out.append(("und", 0.0, None, True))
            continue
        prior = base
        if row[2] is not None and (row[2], row[3]) in by_host:
            prior = smoothed(by_host[row[2], row[3]], smoothed(by_domain[row[3]], base))
        total = [t + math.log(p) + d + s for t, p, d, s in zip(text_logs, prior, declared_logs.get(row[1], nothing), suffix_logs.get(row[4], nothing))]
        best = max(range(len(names)), key=lambda i: (total[i], -i))
        posterior = 1 / sum(math.exp(t - total[best]) for t in total)
        out.append((names[best], posterior, names[g], names[best] == "und" or posterior < least))
    return out


def page_row(url, page):
    declared = re.search(r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", page or "")
    host = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    host = host[1].lower() if host else None
    labels = host.split(".")[::-1] if host else []
    # A missing host leaves an empty domain and no suffix.
    return visible(page), declared[1].lower() if declared else None, host, ".".join(labels[:2]), labels[0] if labels else None
