"""Masked evaluation: every metric is an aggregate over predictions, null where its mask is empty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import safe_log


def rmse(error: Column, mask: Column) -> Column:
    return F.sqrt(F.avg(F.when(mask, error * error)))


def mae(error: Column, mask: Column) -> Column:
    return F.avg(F.when(mask, F.abs(error)))


def share(hit: Column, mask: Column) -> Column:
    return F.avg(F.when(mask, hit.cast("double")))


def by_map_and_all(df: DataFrame, always: Sequence[str], by: str, aggregates: Sequence[Column], everything: str = "all") -> DataFrame:
    """V1: aggregates per always and by, and once more over all of by, in one pass (grouping sets)."""
    sets = [[*(F.col(c) for c in always), F.col(by)], [F.col(c) for c in always]]
    out = df.groupingSets(sets, *always, by).agg(*aggregates, F.grouping(by).alias("__all"))
    return out.withColumn(by, F.when(F.col("__all") == 1, F.lit(everything)).otherwise(F.col(by))).drop("__all")


def event_scores(df: DataFrame, groups: Sequence[str], probability: str, actual: str, mask: str, prior: Column) -> DataFrame:
    """V2: Brier score of the model and of the training prior, prevalence, recall, specificity and precision at 0.5."""
    p, y, m = F.col(probability), F.col(actual), F.col(mask)
    pos, neg, hit = m & (y == 1), m & (y == 0), p >= 0.5
    return df.groupBy(*groups).agg(
        F.count(F.when(m, 1)).alias("samples"),
        F.count(F.when(pos, 1)).alias("positive"),
        F.count(F.when(neg, 1)).alias("negative"),
        F.avg(F.when(m, (p - y) * (p - y))).alias("brier"),
        F.avg(F.when(m, (prior - y) * (prior - y))).alias("prior_brier"),
        F.avg(F.when(m, y.cast("double"))).alias("prevalence"),
        share(hit, pos).alias("recall"),
        share(~hit, neg).alias("specificity"),
        share(y == 1, m & hit).alias("precision"),
    )


def average_precision(df: DataFrame, groups: Sequence[str], score: str, actual: str) -> DataFrame:
    """V3: sum over thresholds of precision times the gain in recall; tied scores are one threshold. Null without a positive.

    Rows are counted by score first, so what a task ranks are a group's distinct scores.
    """
    by = df.groupBy(*groups, score).agg(F.count("*").alias("__n"), F.sum(F.when(F.col(actual) == 1, 1).otherwise(0)).alias("__p"))
    w = W.partitionBy(*groups).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    by = by.withColumn("__tp", F.sum("__p").over(w)).withColumn("__all", F.sum("__n").over(w)).withColumn("__pos", F.sum("__p").over(W.partitionBy(*groups)))
    part = F.when(F.col("__pos") > 0, F.col("__tp") / F.col("__all") * F.col("__p") / F.col("__pos"))
    return by.groupBy(*groups).agg(F.sum(part).alias("average_precision"), F.max("__pos").alias("positive"))


def class_scores(df: DataFrame, groups: Sequence[str], selected: str, target: str, current: str, probability: str) -> DataFrame:
    """V4: accuracy, the keep-as-is baseline, accuracy after a change and without one, cross-entropy. Targets below 0 are unknown."""
    known = F.col(target) >= 0
    had = known & (F.col(current) >= 0)
    changed, stayed = had & (F.col(target) != F.col(current)), had & (F.col(target) == F.col(current))
    hit = F.col(selected) == F.col(target)
    return df.groupBy(*groups).agg(
        F.count(F.when(known, 1)).alias("samples"),
        share(hit, known).alias("accuracy"),
        share(F.col(target) == F.col(current), had).alias("persistence"),
        F.count(F.when(changed, 1)).alias("changed"),
        share(hit, changed).alias("changed_accuracy"),
        share(hit, stayed).alias("same_accuracy"),
        F.avg(F.when(known, -safe_log(probability))).alias("cross_entropy"),
    )


def confusion(df: DataFrame, groups: Sequence[str], selected: str, target: str) -> DataFrame:
    return df.where(F.col(target) >= 0).groupBy(*groups, target, selected).agg(F.count("*").alias("n"))


def class_recall(df: DataFrame, groups: Sequence[str], selected: str, target: str) -> DataFrame:
    """V4: rows, recall and F1 of each target class."""
    c = confusion(df, groups, selected, target)
    right = c.where(F.col(selected) == F.col(target)).select(*groups, F.col(target).alias("class"), F.col("n").alias("hits"))
    rows = c.groupBy(*groups, F.col(target).alias("class")).agg(F.sum("n").alias("samples"))
    called = c.groupBy(*groups, F.col(selected).alias("class")).agg(F.sum("n").alias("called"))
    out = rows.join(right, [*groups, "class"], "left").join(called, [*groups, "class"], "left").fillna(0, ["hits", "called"])
    return out.select(*groups, "class", "samples", (F.col("hits") / F.col("samples")).alias("recall"), (2 * F.col("hits") / (F.col("samples") + F.col("called"))).alias("f1"))


def macro_f1(df: DataFrame, groups: Sequence[str], selected: str, target: str) -> DataFrame:
    """V4: mean F1 over the classes that occur as targets."""
    return class_recall(df, groups, selected, target).groupBy(*groups).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("classes"))


def qualified(before: DataFrame, after: DataFrame, on: Sequence[str], lower_is_better: dict[str, float], higher_is_better: dict[str, float]) -> DataFrame:
    """V5: per key whether each metric was retained: at most factor times as before, or at least before plus a (negative)
    delta. A metric that was null before passes; one that became null fails. accepted is their conjunction."""
    b = before.select(*on, *(F.col(m).alias(f"before_{m}") for m in [*lower_is_better, *higher_is_better]))
    out = b.join(after.select(*on, *lower_is_better, *higher_is_better), list(on), "left")
    rules = {m: F.col(m) <= F.col(f"before_{m}") * f for m, f in lower_is_better.items()} | {m: F.col(m) >= F.col(f"before_{m}") + d for m, d in higher_is_better.items()}
    for m, rule in rules.items():
        out = out.withColumn(f"kept_{m}", F.when(F.col(f"before_{m}").isNull(), True).otherwise(F.coalesce(rule, F.lit(False))))
    ok = F.lit(True)
    for m in rules:
        ok &= F.col(f"kept_{m}")
    return out.withColumn("accepted", ok).select(*on, *(f"kept_{m}" for m in rules), "accepted")


def selection_score(ratios: Sequence[Column], low: float = 0.0, high: float = 2.0) -> Column:
    """V5: the mean of the known ratios, each clipped."""
    kept = F.filter(F.array(*(F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(high)), F.lit(low))) for r in ratios)), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, b: a + b) / F.size(kept))


def dangling(links: DataFrame, nodes: DataFrame, ends: Sequence[str], node: str) -> DataFrame:
    """V6: links with an end that is no node."""
    out = None
    for e in ends:
        part = links.join(nodes.select(F.col(node).alias(e)), e, "left_anti").select(*links.columns)
        out = part if out is None else out.union(part)
    return out.distinct()


def contiguous(df: DataFrame, ids: str) -> DataFrame:
    """V6: one row: count, least, greatest and distinct ids, and whether they are 0 to count - 1."""
    out = df.agg(F.count("*").alias("n"), F.min(ids).alias("least"), F.max(ids).alias("greatest"), F.countDistinct(ids).alias("ids"))
    return out.withColumn("ok", (F.col("n") == 0) | ((F.col("least") == 0) & (F.col("greatest") == F.col("n") - 1) & (F.col("ids") == F.col("n"))))


def violations(df: DataFrame, identity: str, rules: dict[str, Column]) -> DataFrame:
    """V7: (identity, rule) of every rule that a row breaks; a null condition is a violation."""
    names = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items())), lambda n: n.isNotNull())
    return df.select(identity, F.explode(names).alias("rule"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """V8: rows that only one of the tables has (with their multiplicity), and which; none if they are equal."""
    return a.exceptAll(b).withColumn("only_in", F.lit("a")).union(b.exceptAll(a).withColumn("only_in", F.lit("b")))
