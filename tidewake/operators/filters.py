"""Predicates, downsampling and reject accounting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import at, col, finite


def actor_valid(pm_type: str, stats: str, *vectors: str) -> Column:
    """a player in normal play who neither watches nor chases, with finite vectors."""
    ok = (F.col(pm_type) == 0) & (F.size(stats) > 17) & (at(stats, 17) == 0) & (at(stats, 16) == 0)
    for v in vectors:
        ok &= finite(v)
    return F.coalesce(ok, F.lit(False))


def actor_moving(pm_type: str, stats: str, flags: str, *vectors: str) -> Column:
    """F1 for movement: valid, alive, and not held by a teleporter."""
    return actor_valid(pm_type, stats, *vectors) & F.coalesce((at(stats, 1) > 0) & (F.col(flags).bitwiseAND(F.lit(32)) == 0), F.lit(False))


def wanted_maps(segments: DataFrame, wanted: Sequence[str], name: str = "map") -> DataFrame:
    """segments on one of the wanted maps."""
    return segments.where(F.col(name).isin(list(wanted)))


def can_skip(scan: DataFrame, wanted: Sequence[str], code: str, quality: str, maps: str, complete: str) -> DataFrame:
    """scan with skip: a clean scan, read to its end, whose known maps have none of the wanted ones. A scan that stopped
    early may have missed a change of map, so it is never skipped."""
    known = F.size(maps) > 0
    apart = ~F.arrays_overlap(F.col(maps), F.array(*map(F.lit, wanted)))
    return scan.withColumn("skip", F.coalesce((F.col(code) == 0) & (F.col(quality) == 0) & F.col(complete) & known & apart, F.lit(False)))


def first_of_bucket(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, width: int, valid: Column) -> DataFrame:
    """rows in another bucket than the row before them that are valid themselves.

    The row before is the one of the unfiltered table: an invalid first row takes its whole bucket with it.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    bucket = F.floor(F.col(time) / width)
    df = df.withColumn("__new", F.coalesce(bucket != F.lag(bucket).over(w), F.lit(True)))
    return df.where(F.col("__new") & F.coalesce(valid, F.lit(False))).drop("__new")


def anchors(df: DataFrame, time: str, every: int) -> DataFrame:
    """rows whose time is a multiple of every."""
    return df.where(F.col(time) % every == 0)


def strided(df: DataFrame, recording: str, order: Sequence[str], digest: Column, stride: int, most: int | None = None) -> DataFrame:
    """every stride-th row of a recording, from an offset that the digest's first 8 hex digits fix.

    most keeps the first rows by (recording, order).
    """
    offset = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % stride
    n = F.row_number().over(W.partitionBy(recording).orderBy(*order))
    out = df.withColumn("__n", n.cast("long") + offset).where(F.col("__n") % stride == 0).drop("__n")
    return out.orderBy(recording, *order).limit(most) if most is not None else out


def without_outliers(values: Column | str, most: float) -> Column:
    """every element finite and at most most in size."""
    ok = F.forall(col(values), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= most))
    return F.coalesce(ok, F.lit(False))


def of_ids(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows whose id is among ids."""
    return df.join(ids.select(*on), list(on), "left_semi")


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """the name of the first rule that fails the row (a null condition is no failure); null for a row that passes all."""
    return F.coalesce(*(F.when(c, F.lit(n)) for n, c in rules))


def reject_counts(df: DataFrame, rules: Sequence[tuple[str, Column]], kept: str = "kept") -> DataFrame:
    """rows by the first reason that rejects them, and those kept."""
    return df.groupBy(F.coalesce(first_reason(rules), F.lit(kept)).alias("reason")).agg(F.count("*").alias("n"))
