"""The personal-statistics layer that exists as a declaration only: totals, buckets, newest rows, relations, names, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def totals(df: DataFrame, by: Sequence[str], result: str) -> DataFrame:
    """Q1: matches, wins, losses and draws."""
    n = lambda r: F.count(F.when(F.col(result) == r, 1))
    return df.groupBy(*by).agg(F.count("*").alias("matches"), n("win").alias("wins"), n("loss").alias("losses"), n("draw").alias("draws"))


def buckets(df: DataFrame, kinds: Sequence[str], day: str) -> DataFrame:
    """Q2: for each kind of bucket (a column) and name: matches, first and last day; one pass over the table."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("name")) for k in kinds)))
    return df.select(pairs.alias("b"), day).groupBy("b.kind", "b.name").agg(F.count("*").alias("matches"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def newest(df: DataFrame, by: Sequence[str], day: str, identity: str, most: int = 256) -> DataFrame:
    """Q3: the most newest rows of each key, and whether there are more (rows_truncated). Two windows of one exchange."""
    w = W.partitionBy(*by)
    d = df.withColumn("__rn", F.row_number().over(w.orderBy(F.desc(day), identity))).withColumn("rows_truncated", F.count("*").over(w) > most)
    return d.where(F.col("__rn") <= most).drop("__rn")


def relation(players: Column, teams: Column, other_team: Column) -> Column:
    """Q4: head to head for two players without teams; team for players of two sides; placed among more; else unknown."""
    return F.when((players == 2) & teams.isNull(), "head_to_head").when(teams & other_team, "team").when(teams, "unknown").otherwise("placed")


def discovered(df: DataFrame, name: str, recording: str, identity: str) -> DataFrame:
    """Q5: names seen, in how many recordings, and where first."""
    return df.groupBy(F.col(name).alias("name")).agg(F.countDistinct(recording).alias("recordings"), F.min(identity).alias("first_id"))


def duplicates(df: DataFrame, content: str, likely: Sequence[str]) -> DataFrame:
    """Q6: exact for rows of equal content, maybe for rows that agree on what is likely to tell them apart, else none.

    Counts are aggregated before they are joined back, so a much-copied content gathers nowhere.
    """
    by = lambda cols, n: df.groupBy(*cols).agg(F.count("*").alias(n))
    out = df.join(by([content], "__nh"), content).join(by(likely, "__nk"), list(likely))
    return out.withColumn("duplicate", F.when(F.col("__nh") > 1, "exact").when(F.col("__nk") > 1, "maybe").otherwise("none")).drop("__nh", "__nk")
