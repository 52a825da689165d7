"""Language identification that fuses text, declared language, address suffix and host by Bayes' rule."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.rows import nested, row_key, text_of, unnested
from cohortspark.storage import Scratch

UNKNOWN = "und"
BUCKET_BITS = 15
_LETTERS = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint8)


def trigrams(text: str | None) -> np.ndarray:
    """Hashed byte trigrams of the whole lower-cased text; all but letters counts as one space."""
    data = _LETTERS[np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)]
    if not len(data):
        return np.zeros(0, np.int64)
    data = data[np.concatenate(([True], (data[1:] != 32) | (data[:-1] != 32)))].astype(np.uint32)
    if len(data) < 3 or (data == 32).all():
        return np.zeros(0, np.int64)
    codes = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    return ((codes * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


# A tag begins with ``<`` and a letter, ``/``, ``!`` or ``?``; quoted values may hold ``>``. No choice is taken back, so a page takes
# linear time.
_TAG = re.compile(r"""<(?:(?P<raw>script|style)(?=[\s/>])|[a-z/!?])(?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+>""", re.I)
_UNQUOTED = re.compile(r"<(?:(?P<raw>script|style)(?=[\s/>])|[a-z/!?])[^>]*+>", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in ("script", "style")}


def visible(page: str | None) -> str:
    """The text of a page without tags, comments, scripts and styles; one pass over the page.

    Any other ``<`` is text, as in a browser, and so is one whose tag or comment never ends: nothing after it is lost. Only a script
    or style that never ends hides the rest of its page. Once a tag would not end because of its quotes, quotes mean nothing.
    """
    page = page or ""
    out, at, tags = [], 0, _TAG
    last, last_comment = page.rfind(">"), page.rfind("-->")
    while (start := page.find("<", at)) >= 0:
        if start > last:
            break   # no tag ends any more
        stop, tag = -1, None
        if page.startswith("<!--", start):
            if last_comment >= start + 4:
                stop = page.find("-->", start + 4) + 3
        else:
            tag = tags.match(page, start)
            if tag is None and tags is _TAG and _UNQUOTED.match(page, start):
                tags = _UNQUOTED
                tag = tags.match(page, start)
        if tag is not None:
            stop = tag.end()
            if tag["raw"]:
                closed = _RAW_END[tag["raw"].lower()].search(page, stop)
                stop = len(page) if closed is None else closed.end()
        if stop < 0:
            out.append(page[at:start + 1])
            at = start + 1
        else:
            out.append(page[at:start])
            at = stop
    out.append(page[at:])
    return html.unescape(" ".join(out))


class TextModel:
    """Naive Bayes over hashed trigrams, and a uniform model for texts that are in none of the languages."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = [*languages, UNKNOWN], logs   # logs: bucket x language

    @classmethod
    def fit(cls, labelled: DataFrame, label_col: str = "lang", text_col: str = "text", rows: int = 4_000) -> TextModel:
        """Fit on at most ``rows`` distinct texts of each label, those with the smallest hash of label and text.

        Drawn per label, so that a rare language is fitted on all its texts; of distinct texts, so that copies weigh nothing.
        Null labels and texts take no part. Only hashes are counted over all rows; the driver gets at most about ``rows`` of them
        a label, and the executors send one copy of each drawn text per task.
        """
        known = labelled.select(F.col(f"`{label_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).filter(
            "lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("lang", "text"))
        hashes = known.select("lang", "h").distinct()
        numbers = {r["lang"]: r["n"] for r in hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}   # one row per label
        if not numbers:
            return cls([], np.full((1 << BUCKET_BITS, 1), -np.log(1 << BUCKET_BITS)))

        def up_to(last: dict[str, int]) -> Column:
            """Whether a row's hash is among those of its label; labels that are not named are whole."""
            if not last:
                return F.lit(True)
            limits = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
            return F.col("h") <= F.coalesce(F.element_at(limits, F.col("lang")), F.lit((1 << 63) - 1))

        # Hashes are uniform: this share of a label's range holds ``rows`` of them with six deviations to spare.
        large = {x: min((1 << 63) - 1, int((rows + 6 * rows ** 0.5 + 36) / n * 2.0 ** 64) - (1 << 63)) for x, n in numbers.items() if n > rows}
        if large:
            near = hashes.filter(F.col("lang").isin(*large)).filter(up_to(large)).toArrow()
            lang, h = near.column("lang").to_pylist(), near.column("h").to_pylist()
            smallest: dict[str, list[int]] = {x: [] for x in large}
            for x, value in zip(lang, h):
                smallest[x].append(value)
            large = {x: sorted(values)[:rows][-1] if values else large[x] for x, values in smallest.items()}

        def once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[tuple[str, int]] = set()
            for batch in batches:
                fresh = []
                for key in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                    fresh.append(key not in seen)
                    seen.add(key)
                yield batch.filter(pa.array(fresh, pa.bool_()))

        sample = (known.filter(up_to(large)).mapInArrow(once, "lang string, text string, h long")
                  .dropDuplicates(["lang", "h"]).select("lang", "text"))

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}
            for batch in batches:
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    one = np.bincount(trigrams(text.as_py()), minlength=1 << BUCKET_BITS)
                    sums[lang] = sums.get(lang, 0) + one
            for lang, counts in sums.items():
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())],
                                                 names=["lang", "bucket", "n"])

        counted = (sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket")
                   .agg(F.sum("n").alias("n")).toArrow())   # at most languages x buckets rows
        names = sorted(set(counted.column("lang").to_pylist()))
        counts = np.zeros((1 << BUCKET_BITS, len(names)))
        counts[counted.column("bucket").to_numpy(), [names.index(x) for x in counted.column("lang").to_pylist()]] = counted.column("n").to_numpy()
        logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (1 << BUCKET_BITS)))
        return cls(names, np.column_stack([logs, np.full(1 << BUCKET_BITS, -np.log(1 << BUCKET_BITS))]))

    def likelihoods(self, text: str | None, strength: int) -> np.ndarray | None:
        """Log likelihood of each language; neighbouring trigrams depend on each other, so it counts as ``strength`` at most."""
        found = trigrams(text)
        if not len(found):
            return None
        return self.logs[found].sum(axis=0) * (min(len(found), strength) / len(found))


def _evidence(rows: DataFrame, by: str, guess: Column, k: int, alpha: float) -> DataFrame:
    """log P(value | language) for each value, from the languages that texts alone suggest."""
    counts = rows.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("value")).agg(
        F.array(*[F.sum((guess == i).cast("long")) for i in range(k)]).alias("n"))
    totals = counts.agg(*[F.sum(F.col("n")[i]) for i in range(k)], F.count(F.lit(1))).first()
    logs = [F.log((F.col("n")[i] + alpha) / F.lit(float((totals[i] or 0) + alpha * max(1, totals[k])))) for i in range(k)]
    return counts.select(F.col("value").alias(f"{by}_value"), F.array(*logs).alias(f"{by}_logs"))


def identify(scratch: Scratch, rows: DataFrame, model: TextModel, strength: int = 40, alpha: float = 0.5, kappa: float = 4.0,
             min_posterior: float = 0.5, page: bool = False) -> DataFrame:
    """(key, lang, posterior, text_lang, declared, host, rejected) of rows (key, text, declared, host, domain, suffix).

    Whole texts are scored once. Grouped aggregation over all rows then counts how the languages that the texts suggest go
    with declared languages, address suffixes and hosts. A host's prior is smoothed towards its domain's, and that towards
    the prior of all rows, each weighing ``kappa`` rows. The evidence is added in logs:
    text + P(declared | language) + P(suffix | language) + P(language | host). Missing evidence adds nothing.

    A text without letters is rejected as ``und``; so is one that no language explains better than chance, unless other
    evidence outweighs that, and one whose best language has a posterior under ``min_posterior``. Null hosts take the prior of
    all rows. Ties go to the first language by name. Rows are not joined with each other, so repeated keys stay as they are.
    """
    languages, k, logs = model.languages, len(model.languages), model
    fields = "key binary, declared string, host string, domain string, suffix string, logs array<double>"

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                text = text.as_py()
                out.append(logs.likelihoods(visible(text) if page else text, strength))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(i) for i in (2, 3, 4, 5)], pa.array(out, pa.list_(pa.float64()))],
                                             names=["key", "declared", "host", "domain", "suffix", "logs"])

    scored = scratch.cut(rows.select("key", "text", *[F.col(c).cast("string").alias(c) for c in ("declared", "host", "domain", "suffix")])
                         .mapInArrow(score, fields), "scored")
    guess = F.array_position("logs", F.array_max("logs")) - 1
    counted = [F.sum((guess == i).cast("long")) for i in range(k)]
    read = scored.filter("logs IS NOT NULL")
    everywhere = read.agg(*counted).first()
    total = sum(n or 0 for n in everywhere)
    base = [((n or 0) + 1.0) / (total + k) for n in everywhere]
    hosts = read.filter("host IS NOT NULL").groupBy("host", "domain").agg(F.array(*counted).alias("n"))
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.col("n")[i]) for i in range(k)]).alias("m"))

    def smoothed(counts: str, towards: list[Column]) -> Column:
        seen = F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)
        return F.array(*[(F.col(counts)[i] + kappa * towards[i]) / (seen + kappa) for i in range(k)])

    domains = domains.select(F.col("domain").alias("of"), smoothed("m", [F.lit(b) for b in base]).alias("p"))
    priors = scratch.cut(hosts.join(domains, F.col("domain").eqNullSafe(F.col("of"))).select(
        F.col("host").alias("prior_host"), F.col("domain").alias("prior_domain"),
        F.transform(smoothed("n", [F.col("p")[i] for i in range(k)]), lambda x: F.log(x)).alias("prior")), "priors")
    none = F.array(*[F.lit(0.0)] * k)
    whole = F.array(*[F.lit(float(np.log(b))) for b in base])
    fused = (scored.join(priors, (F.col("host") == F.col("prior_host")) & F.col("domain").eqNullSafe(F.col("prior_domain")), "left"))
    for by in ("declared", "suffix"):
        fused = fused.join(_evidence(read, by, guess, k, alpha), F.col(by) == F.col(f"{by}_value"), "left")
    parts = [F.col("logs"), F.coalesce("prior", whole), F.coalesce("declared_logs", none), F.coalesce("suffix_logs", none)]
    fused = fused.withColumn("total", F.array(*[sum((p[i] for p in parts[1:]), parts[0][i]) for i in range(k)]))
    best = F.array_max("total")
    names = F.array(*[F.lit(x) for x in languages])
    weight = F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    found = fused.select("key", "declared", "host", F.when(F.col("logs").isNotNull(), F.element_at(names, (guess + 1).cast("int"))).alias("text_lang"),
                         F.when(F.col("logs").isNotNull(), F.element_at(names, F.array_position("total", best).cast("int"))).otherwise(F.lit(UNKNOWN)).alias("lang"),
                         F.when(F.col("logs").isNotNull(), 1 / weight).otherwise(F.lit(0.0)).alias("posterior"))
    return found.select("key", "lang", "posterior", "text_lang", "declared", "host",
                        ((F.col("lang") == UNKNOWN) | (F.col("posterior") < min_posterior)).alias("rejected"))


def web_evidence(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows for ``identify``: declared markup language, host, domain and address suffix of web pages. The key is the id's digits
    (null stays null)."""
    url, page = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    head = F.regexp_extract(page, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return (pages.select(F.encode(F.col(f"`{key_col}`").cast("string"), "UTF-8").alias("key"), page.alias("text"),
                         F.nullif(F.lower(head), F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
            .withColumn("domain", F.concat_ws(".", F.slice(F.reverse(F.split("host", r"\.")), 1, 2)))
            .withColumn("suffix", F.get(F.reverse(F.split("host", r"\.")), F.lit(0))))


def keep_identified(scratch: Scratch, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang",
                    host_col: str = "source", sample_rows: int = 4_000) -> DataFrame:
    """The rows of ``df`` whose language is identified, with ``declared_col`` as declared language and ``host_col`` as host.

    Rows equal in id and text share the decision that the evidence of either of them supports.
    """
    model = TextModel.fit(df, declared_col, text_col, sample_rows)
    key = row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    rows = df.select(key.alias("key"), text_of(F.col(f"`{text_col}`")).alias("text"), F.col(f"`{declared_col}`").cast("string").alias("declared"),
                     F.col(f"`{host_col}`").cast("string").alias("host"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("suffix"))
    decided = identify(scratch, rows, model)
    rejected = scratch.cut(decided.groupBy("key").agg(F.min("rejected").alias("rejected")).filter("rejected").select("key"), "rejected")
    docs = df.select(nested(df).alias("doc"), key.alias("key"))
    return unnested(docs.join(rejected, "key", "left_anti"), "doc", ())
