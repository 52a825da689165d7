"""Joins of dated events to windows of time, split by person *and* time.

An equi-join on the person alone brings all events of a person to all their windows in one task. Here time is cut into
buckets of ``width`` days: a window stands in every bucket it touches, an event in the bucket of each of its dates, and
they meet by person and bucket. So a person with very many events is spread over tasks, and an event meets only windows
near it. Events of other persons are left out before, by a semi-join that an adaptive plan splits. A pair that could meet
in several buckets is kept in one of them, which follows from its own dates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortspark.sources import of_persons
from cohortspark.storage import shuffled

_BUCKET, _FIRST, _LAST = "_bucket", "_first", "_last"


def _bucket(date: Column, width: int) -> Column:
    return F.floor(F.unix_date(date) / F.lit(width)).cast("int")


def _windows(anchors: DataFrame, first: Column, last: Column, width: int) -> DataFrame:
    """Anchors once for every bucket that their window touches; an empty or unknown window has none."""
    dated = anchors.withColumns({_FIRST: first, _LAST: last}).filter(F.col(_FIRST) <= F.col(_LAST))
    return dated.withColumn(_BUCKET, F.explode(F.sequence(_bucket(F.col(_FIRST), width), _bucket(F.col(_LAST), width))))


def dates_in_windows(anchors: DataFrame, events: DataFrame, dates: Sequence[str], first: Column, last: Column, *,
                     key: str = "person_id", width: int = 180) -> DataFrame:
    """Pairs of anchor and event with the same key of which one of the event's dates lies in ``first``..``last`` (both
    ends included), each pair once."""
    buckets = F.array_distinct(F.filter(F.array(*[_bucket(F.col(d), width) for d in dates]), lambda b: b.isNotNull()))
    near = of_persons(events, anchors, key).withColumn(_BUCKET, F.explode(buckets))
    pairs = shuffled(_windows(anchors, first, last, width)).join(near, [key, _BUCKET])
    # The bucket of the first of the dates that lies in the window.
    chosen = F.coalesce(*[F.when(F.col(d).between(F.col(_FIRST), F.col(_LAST)), _bucket(F.col(d), width)) for d in dates])
    return pairs.filter(F.col(_BUCKET) == chosen).drop(_BUCKET, _FIRST, _LAST)


def spans_in_windows(anchors: DataFrame, events: DataFrame, start: str, end: Column, first: Column, last: Column, *,
                     key: str = "person_id", width: int = 180) -> DataFrame:
    """Pairs of anchor and event with the same key where the event starts by ``last`` and ends at or after ``first``, each
    pair once. A span stands in every bucket that it touches."""
    spans = of_persons(events, anchors, key).withColumn("_end", end)
    low, high = (_bucket(f(F.col(start), F.col("_end")), width) for f in (F.least, F.greatest))
    spans = spans.filter(F.col(start).isNotNull() & F.col("_end").isNotNull()).withColumn(_BUCKET, F.explode(F.sequence(low, high)))
    met = (F.col(start) <= F.col(_LAST)) & (F.col("_end") >= F.col(_FIRST))
    own = F.col(_BUCKET) == _bucket(F.greatest(F.col(start), F.col(_FIRST)), width)
    return (shuffled(_windows(anchors, first, last, width)).join(spans, [key, _BUCKET]).filter(met & own)
            .drop(_BUCKET, _FIRST, _LAST, "_end"))
