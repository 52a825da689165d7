"""URL filter: rules on host and path, and a list of URLs behind a blocked Bloom filter."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.rows import nested, unnested
from cohortspark.storage import Scratch

# Query parameters that name no content.
TRACKING = ("utm_[^=]*", "ref", "fbclid", "gclid")
# The letters that are folded to lower case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
WORDS = 4             # a block has 4 words of 64 bits and a key sets one bit in each of their 8 halves
_BLOCK_BYTES = 64     # of a block's row, with its number


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """The form in which URLs are listed and compared: no scheme, no fragment, no leading ``www.``, no default port, no slash at
    the end of the path, no tracking parameters, the other parameters in order. Null for what has no ``://``."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)?\z", "")
    path = F.regexp_replace(path_of(url), r"/+\z", "")
    named = F.split(F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit("")), "&")
    wanted = F.array_sort(F.filter(named, lambda p: (p != "") & ~p.rlike(f"^({'|'.join(TRACKING)})(=|\\z)")))
    query = F.when(F.size(wanted) > 0, F.concat(F.lit("?"), F.array_join(wanted, "&"))).otherwise("")
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, query))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The rule that fits, ``host + path``, and its verdict; null where none does. ``rules`` are (host, path, verdict). A rule fits
    its host and all subdomains when the path starts with its own; the longest wins (of equal length the longer host, then the
    smaller text). The rules become one expression, so they should be at most some hundreds; longer lists are for ``listed``."""
    rule = verdict = None
    for name, prefix, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        rule = F.when(fits, name + prefix) if rule is None else rule.when(fits, name + prefix)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def _block(key: Column, blocks: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(blocks - 1))


def _masks(key: Column) -> list[Column]:
    """The bits of a key in each word of its block."""
    bits = F.xxhash64(key, F.lit(1))

    def lane(j: int) -> Column:
        place = F.shiftrightunsigned(bits, 5 * j).bitwiseAND(F.lit(31)) + 32 * (j % 2)
        return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))

    return [lane(2 * i).bitwiseOR(lane(2 * i + 1)) for i in range(WORDS)]


def bloom(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The blocked filter of a column's values, one row per block in use: (block, w0, w1, w2, w3)."""
    marks = keys.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return marks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def filter_urls(scratch: Scratch, df: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = (), url_col: str = "url",
                listed_col: str = "url", columns: Sequence[str] | None = None, listed_says: str = "block", others: str = "allow",
                bits_per_key: int = 16, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Every row with ``host``, ``path``, ``canonical``, ``listed`` (whether the canonical URL is in the list), ``rule`` and
    ``verdict``: the rule's if one fits, else ``listed_says`` for listed URLs and ``others`` for the rest.

    The list's canonical URLs set one bit in each of 8 lanes of one 256-bit block. Each row looks at the one block of its own
    key. Rows with an unset bit are not listed and go straight through, unshuffled; possible hits are written and meet the list
    in an exact join, which removes the false positives (about 1 row in 500).

    The filter has ``bits_per_key`` bits for each key at any size of the list. Up to ``broadcast_bytes`` it is sent to every
    executor; a larger one is joined by block, which shuffles the given ``columns`` of all rows, and finds the same hits.
    A hot URL can be split in both joins, as each reads a written table or the input itself.

    A null URL and one without ``://`` have an empty host and path, no canonical form and are never listed. Repeated rows are
    kept, listed URLs may repeat, an empty list lists nothing, and an empty table gives an empty result. Extra columns are
    returned as they are; one named like an added column is replaced. ``columns`` limits the returned input columns.
    """
    keys = scratch.cut(listed.select(canonical(F.col(f"`{listed_col}`").cast("string")).alias("canonical"))
                       .filter("canonical IS NOT NULL").distinct(), "listed")
    blocks = 1
    while blocks * 64 * WORDS < keys.count() * bits_per_key:
        blocks *= 2
    words = scratch.cut(bloom(keys, "canonical", blocks), "blocks")
    words = F.broadcast(words) if blocks * _BLOCK_BYTES <= broadcast_bytes else words.hint("merge")

    url = F.col(f"`{url_col}`").cast("string")
    placed = df.select(nested(df, columns).alias("doc"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    placed = placed.withColumn("block", _block(F.col("canonical"), blocks))
    all_set = reduce(Column.__and__, [F.col(f"w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col("canonical")))])
    probed = placed.join(words, "block", "left").select(
        "doc", "host", "path", "canonical", (F.col("canonical").isNotNull() & F.coalesce(all_set, F.lit(False))).alias("possible"))
    possible = scratch.cut(probed.filter("possible").drop("possible"), "possible")
    found = possible.join(keys.withColumn("listed", F.lit(True)), "canonical", "left").select(
        "doc", "host", "path", "canonical", F.coalesce("listed", F.lit(False)).alias("listed"))
    rows = probed.filter("NOT possible").drop("possible").withColumn("listed", F.lit(False)).unionByName(found)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = rows.withColumn("rule", rule).withColumn(
        "verdict", F.coalesce(verdict, F.when(F.col("listed"), listed_says).otherwise(others)))
    return unnested(judged, "doc", ("host", "path", "canonical", "listed", "rule", "verdict"))
