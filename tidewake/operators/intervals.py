"""Interval joins: rows and the intervals that cover them, with the closedness of each use as a parameter.

A join always has the equi keys (recording, segment, slot ...) first, so it is a hash or sort-merge join with the range
as a residual condition. Where a key has very many intervals, bins= adds a time bin to the equi keys: an interval is
repeated for each bin that it touches, a row has one, and each pair still meets once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def covers(t: Column, start: Column, end: Column, closed: bool = True, identity_end: Column | None = None) -> Column:
    """Whether [start, end] (or [start, end) if not closed) holds t; an identity_end of 0 or null is open, another ends before it."""
    inside = (start <= t) & ((t <= end) if closed else (t < end))
    if identity_end is not None:
        inside &= identity_end.isNull() | (identity_end == 0) | (t < identity_end)
    return inside


def interval_join(
    rows: DataFrame, intervals: DataFrame, on: Sequence[str], time: str, start: str, end: str, closed: bool = True, identity_end: str | None = None, how: str = "left", bins: int | None = None
) -> DataFrame:
    """Rows with every interval of their key that covers them. Columns of intervals other than on must not clash with rows'.

    Null keys match nothing; a left join keeps rows without an interval. how: left, inner, left_semi or left_anti.
    """
    on = list(on)
    i = intervals
    if bins:
        i = i.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / bins), F.greatest(F.floor(F.col(end) / bins), F.floor(F.col(start) / bins)))))
        rows = rows.withColumn("__bin", F.floor(F.col(time) / bins))
        on = [*on, "__bin"]
    i = i.select(*(F.col(c).alias(f"__on_{c}") if c in on else F.col(c) for c in i.columns))
    cond = covers(rows[time], i[start], i[end], closed, i[identity_end] if identity_end else None)
    for c in on:
        cond &= rows[c] == i[f"__on_{c}"]
    out = rows.join(i, cond, how)
    return out.drop("__bin", *(f"__on_{c}" for c in on))


def unique_interval(rows: DataFrame, intervals: DataFrame, on: Sequence[str], key: Sequence[str], time: str, start: str, end: str, take: Sequence[str], **options) -> DataFrame:
    """rows with the columns take of the one interval that covers them; null where none or several do.

    key identifies a row. The count of covering intervals comes along as n_covering.
    """
    met = interval_join(rows, intervals.select(*dict.fromkeys([*on, start, end, *take, *([options["identity_end"]] if options.get("identity_end") else [])])), on, time, start, end, **options)
    n = F.count(start)
    one = {c: F.when(n == 1, F.first(c, ignorenulls=True)).alias(c) for c in take}
    kept = [c for c in rows.columns if c not in key]
    return met.groupBy(*key).agg(*(F.first(c).alias(c) for c in kept), *one.values(), n.alias("n_covering"))


def eligible_pairs(participants: DataFrame, epoch: Sequence[str], slot: str, active: str, kills: str, deaths: str) -> DataFrame:
    """F8: epochs with exactly two participants that took part (active, or with a kill or a death), on different slots."""
    took = participants.where(F.coalesce(F.col(active), F.lit(False)) | (F.coalesce(kills, F.lit(0)) > 0) | (F.coalesce(deaths, F.lit(0)) > 0))
    return took.groupBy(*epoch).agg(F.count("*").alias("n"), F.countDistinct(slot).alias("slots")).where("n = 2 AND slots = 2").select(*epoch)
