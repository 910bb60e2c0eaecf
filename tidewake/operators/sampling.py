"""Deterministic samples, leakage-safe splits, replay and incremental recomputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hex_bucket


def bottom_k(df: DataFrame, groups: Sequence[str], identity: str, k: int) -> DataFrame:
    """The k rows of each group with the least sha256 of their identity. Equal identities count once each.

    Spark keeps k rows a group and task before the exchange (a window group limit), so a hot group is cut down where it lies.
    """
    w = W.partitionBy(*groups).orderBy(F.sha2(F.col(identity).cast("string"), 256), identity)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def sample_then_encode(df: DataFrame, groups: Sequence[str], identity: str, k: int, eligible: Column, encode) -> DataFrame:
    """encode() of the sampled rows only: eligible identities are ranked first, then joined back."""
    chosen = bottom_k(df.where(eligible).select(*groups, identity), groups, identity, k)
    return encode(df.join(chosen.select(identity), identity, "left_semi"))


def pair_group(map_name: Column, a: Column, b: Column, quote=None) -> Column:
    """sha256 of the compact JSON [map,[least,greatest]]; null unless both names are known and differ.

    quote makes a JSON string of a column; the default is for text without quotes, backslashes or non-ASCII characters.
    """
    quote = quote or (lambda c: F.concat(F.lit('"'), c, F.lit('"')))
    low, high = F.least(a, b), F.greatest(a, b)
    key = F.concat(F.lit("["), quote(map_name), F.lit(",["), quote(low), F.lit(","), quote(high), F.lit("]]"))
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.sha2(key, 256))


def split_of(group: Column) -> Column:
    """Quarantine without a group; else by its bucket of ten: 8 validation, 9 test, the others train."""
    bucket = hex_bucket(group, 10)
    return F.when(group.isNull(), "quarantine").when(bucket == 8, "validation").when(bucket == 9, "test").otherwise("train")


def leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """U4: groups that are in more than one split."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def assert_no_leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """U4: df, or an error that names a group in two splits."""
    bad = leaks(df, group, split).first()
    if bad:
        raise ValueError(f"split leakage: {bad[0]} is in {bad[1]} splits")
    return df


def conflicts(old: DataFrame, new: DataFrame, identity: str, payload: Sequence[str]) -> DataFrame:
    """Identities whose payload differs between (or within) the two tables."""
    h = F.sha2(F.to_json(F.struct(*payload)), 256)
    both = old.select(identity, h.alias("h")).union(new.select(identity, h.alias("h")))
    return both.groupBy(identity).agg(F.countDistinct("h").alias("payloads")).where("payloads > 1").select(identity)


def replay_merge(old: DataFrame, new: DataFrame, identity: str, by_map: str, cap: int, split: str | None = None, policy: str = "all", least: int = 0) -> DataFrame:
    """Old and new rows, the new one of equal identities (of several new ones, or several old ones, the one whose JSON has
    the least sha256; conflicts() names them), then the cap // maps rows of each map (and split) with the
    least sha256. policy train caps that split only and keeps the others whole; least bounds the share from below."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    newest = W.partitionBy(identity).orderBy(F.desc("__new"), F.sha2(F.to_json(F.struct(*old.columns)), 256))
    both = both.withColumn("__rn", F.row_number().over(newest)).where("__rn = 1").drop("__rn", "__new")
    scope = [split] if split else []
    maps = both.groupBy(*scope).agg(F.countDistinct(by_map).alias("__maps")) if scope else both.agg(F.countDistinct(by_map).alias("__maps"))
    both = both.join(F.broadcast(maps), scope) if scope else both.join(F.broadcast(maps))
    share = F.greatest(F.floor(F.lit(cap) / F.greatest(F.col("__maps"), F.lit(1))), F.lit(least))
    rank = F.row_number().over(W.partitionBy(*scope, by_map).orderBy(F.sha2(F.col(identity).cast("string"), 256)))
    both = both.withColumn("__rank", rank)
    keep = F.col("__rank") <= share
    if policy == "train":
        keep |= F.col(split) != "train"
    return both.where(keep).drop("__rank", "__maps")


def group_folds(df: DataFrame, by_map: str, group: str, k: int) -> DataFrame:
    """(map, group, fold): groups of a map in sha256 order, fold = rank modulo k."""
    g = df.where(F.col(group).isNotNull()).select(by_map, group).distinct()
    rank = F.row_number().over(W.partitionBy(by_map).orderBy(F.sha2(F.col(group).cast("string"), 256), group)) - 1
    return g.withColumn("fold", (rank % k).cast("int"))


def fold_role(fold: Column, i: int, k: int) -> Column:
    """Validation for fold i, test for the next one, train for the rest."""
    return F.when(fold == i % k, "validation").when(fold == (i + 1) % k, "test").otherwise("train")


def reuse_or_recompute(wanted: DataFrame, cached: DataFrame, on: Sequence[str], recompute) -> DataFrame:
    """Cached rows of the wanted keys, and recompute() of the wanted keys that have none."""
    keys = list(on)
    return cached.join(wanted.select(*keys), keys, "left_semi").unionByName(recompute(wanted.join(cached.select(*keys).distinct(), keys, "left_anti")))


def refresh_sources(old: DataFrame, issues: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """U8: the sources of all three tables, distinct by on; the later table's row counts."""
    both = old.withColumn("__age", F.lit(0)).unionByName(issues.withColumn("__age", F.lit(1))).unionByName(new.withColumn("__age", F.lit(2)))
    rn = F.row_number().over(W.partitionBy(*on).orderBy(F.desc("__age")))
    return both.withColumn("__rn", rn).where("__rn = 1").drop("__rn", "__age")


def content_alias(df: DataFrame, content: Column, address: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(records, locations): one record a content digest, with its first address; and all addresses of each."""
    d = df.withColumn("content_sha", F.sha2(content, 256))
    locations = d.select("content_sha", *address).distinct()
    first = F.min(F.struct(*address)).alias("a")
    return locations.groupBy("content_sha").agg(first, F.count("*").alias("locations")).select("content_sha", "a.*", "locations"), locations


def expand(df: DataFrame, known: DataFrame, on: Sequence[str], exclude: Column, identity: Column, n: int) -> DataFrame:
    """N more rows: not known, not excluded, in sha256 order of identity."""
    rest = df.join(known.select(*on), list(on), "left_anti").where(~exclude)
    return rest.withColumn("__h", F.sha2(identity, 256)).orderBy("__h", *on).limit(n).drop("__h")


def roles(df: DataFrame, recording: str, role: str, group: str, split: str) -> DataFrame:
    """Tricks train, in a group of their own; a recording with two roles keeps none (conflict)."""
    n = F.size(F.collect_set(role).over(W.partitionBy(recording)))
    df = df.withColumn("conflict", n > 1)
    trick = F.col(role) == "tricks"
    return df.withColumn(group, F.when(F.col("conflict"), None).when(trick, F.concat(F.lit("trick-"), F.col(recording))).otherwise(F.col(group))).withColumn(
        split, F.when(F.col("conflict"), "quarantine").when(trick, "train").otherwise(F.col(split))
    )


def by_distinct(df: DataFrame, on: Sequence[str], compute) -> DataFrame:
    """Df with what compute() adds to the distinct values of on: a costly function runs once for each."""
    return df.join(compute(df.select(*on).distinct()), list(on), "left")
