"""Personal data: base patterns, and bootstrapped contextual extraction of identifiers that they miss."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.storage import Scratch

# The kinds in the order of the results. The last one holds what the contexts add.
KINDS = ("email", "ip", "card", "phone", "id")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# Possessive and anchored at the start of a run of digits: the same leftmost matches, in time linear in the text.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
REACH = 32   # characters of a word that a pattern holds
_NEXT = re.compile(rf"[\x20\x09-\x0D]*([^\x20\x09-\x0D]{{0,{REACH}}})")
_DIGITS = re.compile(r"[0-9]+")
_LABEL = re.compile(r"[^=:]*[=:][\"']?")
_EDGE = "\"'.,;:!?()[]{}<>|"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CUTS = re.compile(r"[=:,;\"'\uFF1A\uFF0C\uFF1B\u3002\u3001]+")   # where a word is cut into fields; the wide forms stand in CJK text
_FIELD = re.compile(r"[,;{}&|\uFF0C\uFF1B\u3002\u3001]")           # where the label of a field begins anew
TOKENS = 8   # words that an identifier has at most

Span = tuple[int, int, int]   # kind, start, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind, by kind and start; a match that fails its check is passed over."""
    out = [(0, i, j) for i, j in _emails(text)]
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (part.lstrip("0") or "0" for part in m[0].split("."))):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def _shape(word: str) -> str:
    return _DIGITS.sub("9", word.lower())


def _back(text: str, at: int) -> tuple[int, str]:
    """The word that ends before ``at``, over white space: its last ``REACH`` characters, and where they start."""
    stop = at
    while stop > 0 and _SPACE.match(text[stop - 1]):
        stop -= 1
    start = stop
    while start > 0 and stop - start < REACH and not _SPACE.match(text[start - 1]):
        start -= 1
    return start, text[start:stop]


def contexts(text: str, start: int, end: int, label: str) -> list[str]:
    """Lexical patterns around a word: two words before it; the words on both sides; its own label, as in ``key=value``.

    Words and labels count with the ``REACH`` characters that are next to the span.
    """
    at, one = _back(text, start)
    two = _back(text, at)[1]
    following = _NEXT.match(text, end)
    out = [f"B {_shape(one)} _ {_shape(following[1])}"]
    if one:
        out.append(f"L {_shape(two)} {_shape(one)} _")
    if label:
        out.append(f"K {_shape(label)}_")
    return out


def _label(text: str, low: int, start: int) -> str:
    """The label of a span that begins at ``start`` in a word or field from ``low`` on, as in ``key=`` or ``"key":"``."""
    low = max(low, start - REACH)
    for m in _FIELD.finditer(text, low, start):
        low = m.end()
    return text[low:start]


def _trimmed(text: str, i: int, j: int) -> tuple[int, int]:
    value = text[i:j]
    return i + len(value) - len(value.lstrip(_EDGE)), i + len(value.rstrip(_EDGE))


def _fields(text: str, start: int, stop: int, inside: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, label) of the parts of a word between its cuts and the base spans in it."""
    low = start
    for i, j in [*inside, (stop, stop)]:
        at = low
        for m in _CUTS.finditer(text, low, max(low, i)):
            if at < m.start():
                yield at, m.start(), _label(text, low, at)
            at = m.end()
        if at < i:
            yield at, i, _label(text, low, at)
        low = max(low, j)


def seed_spans(text: str, base: list[Span]) -> list[tuple[int, int, list[str]]]:
    """(start, end, patterns) of the base spans."""
    out, reached = [], 0
    for _, i, j in sorted(base, key=lambda b: b[1:]):
        at = i
        while at > 0 and i - at < REACH and not _SPACE.match(text[at - 1]):
            at -= 1
        out.append((i, j, contexts(text, at, j, _label(text, max(at, min(reached, i)), i))))
        reached = max(reached, j)
    return out


class Slots:
    """Patterns arranged for finding their slots in a text."""

    def __init__(self, patterns: Iterable[str]):
        self.both: dict[str, set[str]] = {}
        self.left: dict[str, set[str]] = {}
        self.labels: set[str] = set()
        for p in patterns:
            if p[0] == "K":
                self.labels.add(p[2:-1])
            else:
                one, other = (p[2:].split(" _ ") if p[0] == "B" else p[2:-2].split(" ")[::-1])
                (self.both if p[0] == "B" else self.left).setdefault(one, set()).add(other)

    def drop(self, p: str) -> None:
        if p[0] == "K":
            self.labels.discard(p[2:-1])
            return
        one, other = (p[2:].split(" _ ") if p[0] == "B" else p[2:-2].split(" ")[::-1])
        group = self.both if p[0] == "B" else self.left
        if one in group:
            group[one].discard(other)
            if not group[one]:
                del group[one]

    def fillers(self, text: str, base: list[Span]) -> Iterator[tuple[int, int, str]]:
        """(start, end, pattern) of what stands in the slots, whatever its shape, outside base spans.

        Between two trusted sides: 1 to ``TOKENS`` words. After trusted words: the next word, and the words with digits that
        follow a word with digits. After a trusted label: the field.
        """
        if not (self.both or self.left or self.labels):
            return
        plain = _WORD.findall(text)
        heads = _WORD.findall(_shape(text))   # neither lower case nor digits move the white space, so words stay words
        tails = heads
        if any(len(word) > REACH for word in plain):
            heads = [h if len(word) <= REACH else _shape(word[:REACH]) for h, word in zip(heads, plain)]
            tails = [h if len(word) <= REACH else _shape(word[-REACH:]) for h, word in zip(heads, plain)]
        keys = self.both.keys() | self.left.keys()
        after = [0] if "" in keys else []
        after += [w for w, one in enumerate(tails, 1) if one in keys]
        if not after and not (self.labels and _CUTS.search(text)):
            return
        words = [m.span() for m in _WORD.finditer(text)]
        taken = sorted((i, j) for _, i, j in base)
        reached = list(accumulate((j for _, j in taken), max))
        last = len(words)

        def free(i: int, j: int) -> bool:
            before = bisect_left(taken, (j,))
            return i < j and not (before and reached[before - 1] > i)

        def spot(w: int, v: int) -> tuple[int, int]:
            head = _LABEL.match(text, words[w][0], words[w][1])
            return _trimmed(text, head.end() if head and head.end() < words[w][1] else words[w][0], words[v][1])

        for w in after:
            if w == last:
                break
            start, one = words[w][0], tails[w - 1] if w else ""
            rights = self.both.get(one)
            if rights:
                for v in range(w, min(w + TOKENS, last)):
                    following = heads[v + 1] if v + 1 < last else ""
                    if following in rights:
                        i, j = spot(w, v)
                        if free(i, j):
                            yield i, j, f"B {one} _ {following}"
            twos = self.left.get(one) if w else None
            if twos:
                two = tails[w - 2] if w > 1 else ""
                if two in twos:
                    v = w
                    while "9" in heads[v] and v + 1 < min(w + TOKENS, last) and "9" in heads[v + 1] and free(start, words[v + 1][1]):
                        v += 1
                    i, j = spot(w, v)
                    if free(i, j):
                        yield i, j, f"L {two} {one} _"
        done = 0
        for m in _CUTS.finditer(text) if self.labels else ():
            if m.start() < done:
                continue
            start, done = words[bisect_right(words, (m.start(), len(text))) - 1]
            inside = [t for t in taken[bisect_left(reached, start + 1):bisect_left(taken, (done,))] if t[1] > start] if taken else []
            for i, j, label in _fields(text, start, done, inside):
                if label and _shape(label) in self.labels:
                    i, j = _trimmed(text, i, j)
                    if i < j:
                        yield i, j, f"K {_shape(label)}_"


def candidates(text: str, base: list[Span], min_chars: int, min_digits: int, slots: Slots | None = None) -> list[tuple[int, int, bool, list[str]]]:
    """(start, end, whether it is a seed, patterns) of the base spans, of words and fields with many digits, and of what fills
    the slots of trusted patterns."""
    out = [(i, j, True, patterns) for i, j, patterns in seed_spans(text, base)]
    taken = sorted((i, j) for _, i, j in base)
    reached = list(accumulate((j for _, j in taken), max))   # the furthest end of the base spans up to each one
    others: dict[tuple[int, int], dict[str, None]] = {}
    seen = 0
    for m in _DIGIT.finditer(text):
        if m.start() < seen:
            continue
        start = m.start()
        while start > seen and not _SPACE.match(text[start - 1]):
            start -= 1
        stop = _SPACE.search(text, m.end())
        seen = stop.start() if stop else len(text)
        inside = taken[bisect_left(reached, start + 1):bisect_left(taken, (seen,))]
        parts = list(_fields(text, start, seen, inside))
        if not inside:
            head = _LABEL.match(text, start, seen)
            at = head.end() if head else start
            if not _FIELD.search(text, *_trimmed(text, at, seen)):   # one field, not a record
                parts.append((at, seen, text[start:at][-REACH:]))
        for i, j, label in parts:
            i, j = _trimmed(text, i, j)
            if j - i >= min_chars and sum("0" <= c <= "9" for c in text[i:j]) >= min_digits:
                others.setdefault((i, j), {}).update(dict.fromkeys(contexts(text, start, seen, label)))
    for i, j, pattern in (slots.fillers(text, base) if slots else ()):
        others.setdefault((i, j), {})[pattern] = None
    return out + [(i, j, False, list(patterns)) for (i, j), patterns in sorted(others.items())]


FOUND = "doc struct<id:{id}>, spans array<struct<kind:int,start:int,stop:int>>, cands array<struct<start:int,stop:int,seed:boolean,value:long,patterns:array<string>>>"


def extract(scratch: Scratch, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, min_seeds: int = 3,
            min_pattern: float = 0.6, min_instance: float = 0.7, min_chars: int = 6, min_digits: int = 4) -> DataFrame:
    """(id, base, added) of every row: spans (kind, start, stop) in code points, ``base`` by kind and start, ``added`` by start.

    Base spans of all documents are seeds. Their contexts are lexical patterns. A pattern with at least ``min_seeds`` distinct
    seeds, whose seeds are at least ``min_pattern`` of all that fills its slot, opens the slot: what stands there is a candidate
    of any shape and of up to ``TOKENS`` words (see ``Slots.fillers``). Words and fields with ``min_chars`` characters and
    ``min_digits`` digits are candidates anywhere, with their own patterns. Counted over all documents, patterns and distinct
    instances form a graph. In each round a pattern's score is the trust in its instances, summed, over their number plus one, and
    0 for fewer than ``min_seeds`` distinct trusted instances; an instance's trust is 1 for a seed, else one minus the product of
    (1 - score) over its patterns with a score of at least ``min_pattern``. After the last round, an occurrence in such a
    pattern whose instance is trusted at ``min_instance`` is an added span; it never overlaps a base span, and of added spans that
    overlap the leftmost and then longest stays.

    Limits: slots are opened by the seeds alone, so patterns that later rounds learn find only words and fields with digits.
    Several words without digits are found only between two trusted sides. Text without spaces is cut at field marks and base
    spans only, and a field needs a label, so columns of a file without keys are found by their digits alone.

    A null or empty text has no spans. Copies of a text add no distinct instances, so they lend a pattern no trust. Repeated rows
    are each answered. Rows keep null ids. Extra columns are ignored; an empty table gives an empty result. Texts are read
    three times, in linear time: for the seeds, for what fills their patterns, and for the candidates. The patterns of at least
    ``min_seeds`` seeds go to the driver and to all tasks. A hot pattern or instance is one row per neighbour after counting, its
    scores are sums that combine within tasks, and joins on it are plain equi-joins.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    span_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
    cand_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("seed", pa.bool_()), ("value", pa.int64()),
                                    ("patterns", pa.list_(pa.string()))]))

    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    pair = "pattern string, value long"

    def pairs(rows: list[tuple[str, int | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["pattern", "value"])

    def induce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            rows = set()
            for text in batch.column(0):
                text = text.as_py() or ""
                for i, j, patterns in seed_spans(text, base_spans(text)):
                    value = xxh3_64_intdigest(text[i:j].encode("utf-8", "surrogatepass")) - (1 << 63)
                    rows.update((p, value) for p in patterns)
            yield pairs(list(rows))

    induced = {r["pattern"]: r["n"] for r in texts.select("text").mapInArrow(induce, pair).distinct().groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_seeds).collect()}

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct fillers per pattern, or a null as soon as they are too many for the pattern's score."""
        from xxhash import xxh3_64_intdigest

        index, values = Slots(induced), {}
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                for i, j, p in list(index.fillers(text, base_spans(text))):
                    own = values.setdefault(p, set())
                    if own is None:
                        continue
                    own.add(xxh3_64_intdigest(text[i:j].encode("utf-8", "surrogatepass")) - (1 << 63))
                    if induced[p] < min_pattern * (induced[p] + len(own) + 1):
                        values[p] = None
                        index.drop(p)
        yield pairs([(p, v) for p, own in values.items() for v in ((None,) if own is None else own)])

    trusted = set(induced)
    if induced:
        filled = texts.select("text").mapInArrow(fill, pair).distinct().groupBy("pattern").agg(
            F.count("value").alias("n"), F.max(F.col("value").isNull()).alias("many")).collect()   # at most one row per induced pattern
        trusted -= {r["pattern"] for r in filled if r["many"] or induced[r["pattern"]] < min_pattern * (induced[r["pattern"]] + r["n"] + 1)}
        trusted = {p for p in trusted if induced[p] >= min_pattern * (induced[p] + 1)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        slots = Slots(trusted)
        for batch in batches:
            spans, cands = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                spans.append([{"kind": k, "start": i, "stop": j} for k, i, j in base])
                cands.append([{"start": i, "stop": j, "seed": seed, "value": xxh3_64_intdigest(text[i:j].encode("utf-8", "surrogatepass")) - (1 << 63),
                               "patterns": patterns}
                              for i, j, seed, patterns in (candidates(text, base, min_chars, min_digits, slots)
                                                      if base or trusted or _DIGIT.search(text) else ())])
            doc = pa.StructArray.from_arrays([batch.column(0)], names=["id"])
            yield pa.RecordBatch.from_arrays([doc, pa.array(spans, span_type), pa.array(cands, cand_type)], names=["doc", "spans", "cands"])

    found = scratch.cut(texts.mapInArrow(run, FOUND.format(id=id_type)).withColumn("row", F.monotonically_increasing_id()), "found")
    each = found.select("row", F.explode("cands").alias("c")).select("row", "c.*")
    graph = scratch.cut(each.select("value", "seed", F.explode("patterns").alias("pattern"))
                        .groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "graph")
    seeds = graph.withColumn("trust", F.col("seed").cast("double"))
    for n in range(rounds):
        known = seeds if n == 0 else (graph.join(trust, "value", "left")   # noqa: F821 - set below
                                      .withColumn("trust", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("found_trust", F.lit(0.0)))))
        patterns = scratch.cut(known.groupBy("pattern").agg(
            F.sum("trust").alias("sum"), F.count(F.lit(1)).alias("n"), F.sum((F.col("trust") >= min_instance).cast("int")).alias("trusted"))
            .filter(F.col("trusted") >= min_seeds).select("pattern", (F.col("sum") / (F.col("n") + 1)).alias("score"))
            .filter(F.col("score") >= min_pattern), "patterns")
        trust = scratch.cut(graph.filter(~F.col("seed")).join(patterns, "pattern").groupBy("value").agg(
            (1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("found_trust")), "trust")
    accepted = trust.filter(F.col("found_trust") >= min_instance).select("value")
    hits = (each.filter(~F.col("seed")).join(accepted, "value", "left_semi")
            .select("row", "start", "stop", F.explode("patterns").alias("pattern")).join(patterns, "pattern", "left_semi")
            .select("row", F.struct(F.lit(len(KINDS) - 1).alias("kind"), "start", "stop").alias("span")).groupBy("row")
            .agg(F.collect_set("span").alias("added")))
    # by start, the longest first; a span that begins before the last kept one ends is left out
    ordered = F.expr("array_sort(added, (a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start ELSE b.stop - a.stop END)")
    hits = hits.select("row", ordered.alias("added")).withColumn("added", F.expr(
        "aggregate(added, slice(added, 1, 0), (kept, s) -> IF(size(kept) > 0 AND get(kept, size(kept) - 1).stop > s.start, kept, concat(kept, array(s))))"))
    none = F.expr("CAST(array() AS array<struct<kind:int,start:int,stop:int>>)")
    return found.select("row", "doc", "spans").join(hits, "row", "left").select(
        F.col("doc.id").alias("id"), F.coalesce("spans", none).alias("base"), F.coalesce("added", none).alias("added"))
