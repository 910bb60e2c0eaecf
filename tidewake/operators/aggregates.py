"""Aggregates whose exactness is part of their meaning: nearest ranks, equal weights, capped lists that keep counting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


def counters(df: DataFrame, *parts: Column | str, name: str = "counter") -> DataFrame:
    """A1: counts by composite key "a/b/..."."""
    return df.groupBy(F.concat_ws("/", *parts).alias(name)).agg(F.count("*").alias("n"))


def nearest_ranks(df: DataFrame, groups: Sequence[str], value: str, qs: Sequence[float] = QUANTILES) -> DataFrame:
    """A2: per group n and the values at rank round_half_even((n - 1) q) of the sorted non-null values, as q_<percent>.

    Exact without gathering a group: values are counted first, then ranked by a running sum over the distinct ones, so
    a task holds a group's distinct values at most and streams through them. Groups without values have n = 0.
    """
    per = df.groupBy(*groups, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    known = F.when(F.col("__v").isNotNull(), F.col("__c")).otherwise(0)
    w = W.partitionBy(*groups)
    per = per.withColumn("__n", F.sum(known).over(w)).withColumn("__up", F.sum(known).over(w.orderBy(F.col("__v").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)))
    rank = lambda q: F.bround((F.col("__n") - 1) * F.lit(float(q))).cast("long")
    pick = [F.min(F.when(F.col("__v").isNotNull() & (F.col("__up") > rank(q)), F.col("__v"))).alias(f"q_{round(q * 100)}") for q in qs]
    return per.groupBy(*groups).agg(F.max("__n").alias("n"), *pick)


def linear_quantiles(df: DataFrame, groups: Sequence[str], value: str, qs: Sequence[float], order: Sequence[str] | None = None, first: int | None = None) -> DataFrame:
    """A3: interpolated quantiles as p_<percent>; with first, of the group's first rows in the given order."""
    if first is not None:
        df = df.withColumn("__rn", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("__rn") <= first)
    return df.groupBy(*groups).agg(*(F.percentile(value, q).alias(f"p_{round(q * 100)}") for q in qs))


def equal_weight_shares(df: DataFrame, condition: Sequence[str], unit: str, label: str, least_rows: int = 30, least_units: int = 3) -> DataFrame:
    """Per condition and label the mean over units (recordings) of the label's share within the unit.

    A unit without the label counts as 0; supported says whether there are enough rows and units.
    """
    cells = df.groupBy(*condition, unit, label).agg(F.count("*").alias("__n"))
    units = W.partitionBy(*condition, unit)
    shares = cells.withColumn("__share", F.col("__n") / F.sum("__n").over(units))
    totals = cells.groupBy(*condition).agg(F.countDistinct(unit).alias("units"), F.sum("__n").alias("samples"))
    by = shares.groupBy(*condition, label).agg(F.sum("__share").alias("__sum"))
    out = by.join(totals, list(condition)).withColumn("share", F.col("__sum") / F.col("units"))
    return out.withColumn("supported", (F.col("samples") >= least_rows) & (F.col("units") >= least_units)).drop("__sum")


def mean_of_means(df: DataFrame, condition: Sequence[str], unit: str, value: str, order: Sequence[str], first: int = 2000) -> DataFrame:
    """A5: mean over units of the mean of a unit's first rows in the given order."""
    capped = df.withColumn("__rn", F.row_number().over(W.partitionBy(*condition, unit).orderBy(*order))).where(F.col("__rn") <= first)
    return capped.groupBy(*condition, unit).agg(F.avg(value).alias("__m")).groupBy(*condition).agg(F.avg("__m").alias("mean"), F.count("*").alias("units"))


def occupancy(df: DataFrame, groups: Sequence[str], axes: Sequence[str], width: int, grounded: str) -> DataFrame:
    """Frames and ground contacts by cell."""
    cells = [F.floor(F.col(a) / width).alias(f"cell_{a}") for a in axes]
    return df.groupBy(*groups, *cells).agg(F.count("*").alias("frames"), F.sum(F.col(grounded).cast("long")).alias("contacts"))


def transitions(df: DataFrame, keys: Sequence[str], order: Sequence[str], state: Column, groups: Sequence[str], unbroken: Column | None = None) -> DataFrame:
    """Counts of moves from one state to a different one on consecutive rows of a key, where unbroken holds."""
    w = W.partitionBy(*keys).orderBy(*order)
    moved = df.withColumn("to_state", state).withColumn("from_state", F.lag(state).over(w))
    if unbroken is not None:
        moved = moved.withColumn("__ok", unbroken).where("__ok")
    return moved.where("from_state <> to_state").groupBy(*groups, "from_state", "to_state").agg(F.count("*").alias("n"))


def capped_cells(df: DataFrame, groups: Sequence[str], axes: Sequence[str], order: Sequence[str], width: int = 64, per_cell: int = 8, cells: int = 8192) -> DataFrame:
    """The first cells of each group in order, each with its count and the mean of its first per_cell positions."""
    cell = [F.floor(F.col(a) / width).alias(f"cell_{a}") for a in axes]
    names = [f"cell_{a}" for a in axes]
    d = df.select(*groups, *order, *axes, *cell)
    d = d.withColumn("__rn", F.row_number().over(W.partitionBy(*groups, *names).orderBy(*order)))
    means = [F.avg(F.when(F.col("__rn") <= per_cell, F.col(a))).alias(f"mean_{a}") for a in axes]
    by = d.groupBy(*groups, *names).agg(F.count("*").alias("n"), *means, F.min(F.struct(*order)).alias("__first"))
    ranked = by.withColumn("__rank", F.row_number().over(W.partitionBy(*groups).orderBy("__first")))
    return ranked.where(F.col("__rank") <= cells).drop("__rank", "__first")


def top_phrases(df: DataFrame, by: Sequence[str], text: str, k: int = 200, most: int = 160) -> DataFrame:
    """The k most common (by, text) of 1 to most characters without control characters; ties by text."""
    ok = df.where(F.length(text).between(1, most) & ~F.col(text).rlike(r"[\x00-\x1F\x7F]"))
    n = ok.groupBy(*by, text).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), *by, text).limit(k)


def fingerprints(df: DataFrame, groups: Sequence[str], order: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """sha256 over a group's rows in order; each row its parts, joined. Rows are hashed before they are gathered."""
    row = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("~")) for p in parts)), 256)
    d = df.select(*groups, F.struct(*order, row.alias("__h")).alias("__r"))
    return d.groupBy(*groups).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("__r")), lambda r: r["__h"]), ","), 256).alias("fingerprint"))


def digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row whose count and digest don't depend on the order of df's rows."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.sum(h).alias("digest"))


def class_weights(df: DataFrame, label: str, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """Per known class (label >= 0) clip(sqrt(mean count / count), low, high); df: training rows only."""
    n = df.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n"))
    mean = F.avg("n").over(W.partitionBy(F.lit(1)))
    return n.withColumn("weight", F.greatest(F.least(F.sqrt(mean / F.col("n")), F.lit(high)), F.lit(low)))


def switch_factor(df: DataFrame, target: str, current: str, low: float = 1.0, high: float = 8.0) -> DataFrame:
    """clip(known / changed, low, high) of training rows."""
    known = (F.col(target) >= 0) & (F.col(current) >= 0)
    changed = known & (F.col(target) != F.col(current))
    k, c = F.count(F.when(known, 1)), F.count(F.when(changed, 1))
    return df.agg(k.alias("known"), c.alias("changed"), F.greatest(F.least(k / F.greatest(c, F.lit(1)), F.lit(high)), F.lit(low)).alias("factor"))


def positive_weight(df: DataFrame, event: str, mask: str, most: float = 16.0) -> DataFrame:
    """min(most, sqrt(negative / positive)) of the known training rows; null without a positive one."""
    pos, neg = F.count(F.when(F.col(mask) & (F.col(event) == 1), 1)), F.count(F.when(F.col(mask) & (F.col(event) == 0), 1))
    return df.agg(pos.alias("positive"), neg.alias("negative"), F.when(pos > 0, F.least(F.sqrt(neg / pos), F.lit(most))).alias("weight"))


def majority(df: DataFrame, groups: Sequence[str], label: str) -> DataFrame:
    """The most common label of each group; of equals the least."""
    n = df.where(F.col(label).isNotNull()).groupBy(*groups, label).agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col(label)).alias("__neg")))
    return n.groupBy(*groups).agg(best.alias("b")).select(*groups, (-F.col("b.__neg")).alias("majority"), F.col("b.n").alias("n"))


def participant_facts(df: DataFrame, participant: Sequence[str], kind: str, amount: str, total: str = "total") -> DataFrame:
    """Per participant and kind (a weapon, an item) how many facts there are and what they add up to; facts without a kind don't count."""
    return df.where(F.col(kind).isNotNull()).groupBy(*participant, kind).agg(F.count("*").alias("n"), F.sum(amount).cast("long").alias(total))


def coverage(df: DataFrame, by: Sequence[str], size: str, content: Column) -> DataFrame:
    """Rows, total size and distinct contents by each of the columns alone, and of everything, in one pass."""
    d = df.select(*by, F.col(size).alias("__size"), F.md5(content).alias("__h"))
    sets = [[F.col(c)] for c in by] + [[]]
    return d.groupingSets(sets, *by).agg(F.count("*").alias("n"), F.sum("__size").alias("total"), F.countDistinct("__h").alias("contents"))


def distinct_units(df: DataFrame, by: Sequence[str], unit: str, positive: Column, name: str = "units") -> DataFrame:
    """Per group its distinct units, and those with a positive row."""
    return df.groupBy(*by).agg(F.countDistinct(unit).alias(name), F.countDistinct(F.when(positive, F.col(unit))).alias("positive"))


def capped_events(df: DataFrame, groups: Sequence[str], order: Sequence[str], payload: Sequence[str], most: int) -> DataFrame:
    """The count of all of a group's events, and a list of the first most of them."""
    d = df.withColumn("__rn", F.row_number().over(W.partitionBy(*groups).orderBy(*order)))
    first = F.array_sort(F.collect_list(F.when(F.col("__rn") <= most, F.struct("__rn", *payload))))
    return d.groupBy(*groups).agg(F.count("*").alias("n"), F.transform(first, lambda r: F.struct(*(r[c].alias(c) for c in payload))).alias("events"))
