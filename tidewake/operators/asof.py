"""As-of joins and carry-forward without nested loops: both sides are put in one ordered stream per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """For each name the last non-null value of its column up to the row, within the key."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({name: F.last(c, ignorenulls=True).over(w) for name, c in columns.items()})


def merge_streams(streams: dict[str, DataFrame], keys: Sequence[str], seq: str) -> DataFrame:
    """Several record streams as one table with a kind column, ready for carry_forward by seq."""
    out = None
    for kind, df in streams.items():
        part = df.select(*keys, seq, *(c for c in df.columns if c not in {*keys, seq})).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def asof_backward(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str], right_order: Sequence[str], take: Sequence[str], ages: tuple[str, str, Sequence[int]] | tuple[str, str, int] | None = None, prefix: str = "prior_"
) -> DataFrame:
    """Each left row with the columns take (prefixed) of the last right row of its key at or before it.

    Orders are compared position by position; on equal order a right row counts as before a left one. ages: (left
    time, right time, allowed): a list of exact ages or a largest one; beyond it the match is null, not replaced by an
    older row. One union and one window: n log n, whatever the number of matches.
    """
    take_all = list(dict.fromkeys([*take, *([ages[1]] if ages else [])]))
    names = [f"__o{i}" for i in range(len(left_order))]
    l = left.select(F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*take_all).alias("s")).schema["s"].dataType).alias("__r"), *(F.col(k) for k in keys), *(F.col(c).alias(n) for n, c in zip(names, left_order)), F.lit(1).alias("__side"))  # noqa: E741
    r = right.select(F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("__l"), F.struct(*take_all).alias("__r"), *(F.col(k) for k in keys), *(F.col(c).alias(n) for n, c in zip(names, right_order)), F.lit(0).alias("__side"))
    w = W.partitionBy(*keys).orderBy(*names, "__side").rowsBetween(W.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    match = F.col("__m")
    if ages:
        age = F.col(f"__l.{ages[0]}") - F.col(f"__m.{ages[1]}")
        match = F.when(age <= ages[2] if isinstance(ages[2], int) else age.isin(list(ages[2])), match)
    return out.withColumn("__m", match).select("__l.*", *(F.col(f"__m.{c}").alias(f"{prefix}{c}") for c in take))


def asof_forward(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, time: str, within: int, take: Sequence[str], accept: Column | None = None, prefix: str = "next_") -> DataFrame:
    """Each left row with the columns take (prefixed) of the first right row of its key behind it (greater order),
    not before it in time and at most within later; accept drops right rows from the search.

    The nearest later row by order decides: one beyond the time is no match, not a reason to look further.
    """
    right = right.where(accept) if accept is not None else right
    take_all = list(dict.fromkeys([*take, time]))
    l = left.select(F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*take_all).alias("s")).schema["s"].dataType).alias("__r"), *keys, F.col(order).alias("__o"), F.lit(1).alias("__side"))  # noqa: E741
    r = right.select(F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("__l"), F.struct(*take_all).alias("__r"), *keys, F.col(order).alias("__o"), F.lit(0).alias("__side"))
    w = W.partitionBy(*keys).orderBy(F.col("__o").desc(), F.col("__side").desc()).rowsBetween(W.unboundedPreceding, 0)
    # Going backwards, a right row of the same order comes after the left one, and so isn't behind it.
    out = l.unionByName(r).withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    dt = F.col(f"__m.{time}") - F.col(f"__l.{time}")
    out = out.withColumn("__m", F.when(dt.between(0, within), F.col("__m")))
    return out.select("__l.*", *(F.col(f"__m.{c}").alias(f"{prefix}{c}") for c in take))


def adjacent(df: DataFrame, keys: Sequence[str], time: str, step: int, take: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """The columns take of the row before, where it is exactly step earlier; else null."""
    w = W.partitionBy(*keys).orderBy(time)
    ok = F.col(time) - F.lag(time).over(w) == step
    return df.withColumns({f"{prefix}{c}": F.when(ok, F.lag(c).over(w)) for c in take})


def opponents(df: DataFrame, epoch: Sequence[str], slot: str, take: Sequence[str], prefix: str = "enemy_") -> DataFrame:
    """Each row with the columns take (prefixed) of the other slots of its epoch and instant (both directions of a pair)."""
    other = df.select(*(F.col(c).alias(f"__{c}") for c in epoch), F.col(slot).alias(f"{prefix}{slot}"), *(F.col(c).alias(f"{prefix}{c}") for c in take if c != slot))
    cond = F.col(slot) != F.col(f"{prefix}{slot}")
    for c in epoch:
        cond &= F.col(c) == F.col(f"__{c}")
    return df.join(other, cond).drop(*(f"__{c}" for c in epoch))


def dictionary_asof(rows: DataFrame, settings: DataFrame, keys: Sequence[str], index: str, seq: str, text: str, name: str) -> DataFrame:
    """Rows with the text that their index (a setting's number) had last been given at their seq."""
    return asof_backward(rows, settings.select(*keys, index, seq, text), [*keys, index], [seq], [seq], [text], prefix="__").withColumnRenamed(f"__{text}", name)


def catalog(records: DataFrame, locations: DataFrame, record: str, location: str, current: Column, take: Sequence[str]) -> DataFrame:
    """The distinct columns take of records and their locations of the current run."""
    return records.join(locations.where(current), records[record] == locations[location]).select(*take).distinct()


def attach(rows: DataFrame, groups: DataFrame, on: Sequence[str], drop: Column) -> DataFrame:
    """Rows with their group's columns; rows without a group, or whose group drop holds for, are left out."""
    return rows.join(groups.where(~drop), list(on))


def unattached(rows: DataFrame, groups: DataFrame, on: Sequence[str], drop: Column) -> DataFrame:
    """The rows that attach() leaves out."""
    return rows.join(groups.where(~drop), list(on), "left_anti")


def named_target(sources: DataFrame, targets: DataFrame, source_name: str, target_name: str, take: Sequence[str], on: Sequence[str] = ()) -> DataFrame:
    """Sources with the columns take of the one target of that name; reason says missing_target or ambiguous_target
    where there is none or more than one, and the first is never chosen. on: further equal columns (a map's name)."""
    n = F.count("*")
    by = targets.where(F.col(target_name).isNotNull()).groupBy(*on, F.col(target_name).alias(source_name))
    one = by.agg(*(F.when(n == 1, F.first(c)).alias(c) for c in take), n.alias("__n"))
    out = sources.join(one, [*on, source_name], "left")
    reason = F.when(F.col("__n").isNull(), "missing_target").when(F.col("__n") > 1, "ambiguous_target")
    return out.withColumn("reason", reason).drop("__n")


def spoken_lines(events: DataFrame, tracks: DataFrame, on: Sequence[str], event_id: str, time: str, text: str, alias: str, start: str, end: str) -> DataFrame:
    """(event columns, alias, line) of lines that begin with "alias: " of exactly one alias current at that time."""
    from .intervals import interval_join

    met = interval_join(events, tracks.select(*on, alias, start, end), on, time, start, end, how="inner").where(F.col(text).startswith(F.concat(F.col(alias), F.lit(": "))))
    kept = [c for c in events.columns if c != event_id]
    out = met.groupBy(event_id).agg(*(F.first(c).alias(c) for c in kept), F.countDistinct(alias).alias("__n"), F.first(alias).alias(alias)).where("__n = 1").drop("__n")
    return out.withColumn("line", F.substr(F.col(text), F.length(alias) + 3))


def closure(start: DataFrame, edges: DataFrame, root: str = "root", name: str = "name", source: str = "source", target: str = "target", most: int = 64) -> DataFrame:
    """(root, name) of everything reachable from each root along edges, each name once, the start included.

    Only names that are new in a round go into the next; its lineage is cut each round.
    """
    from ..sources.catalog import checkpointed

    seen = checkpointed(start.select(root, name).distinct())
    front = seen
    for _ in range(most):
        step = front.join(edges.select(F.col(source).alias(name), F.col(target).alias("__to")), name).select(root, F.col("__to").alias(name)).distinct()
        front = checkpointed(step.join(seen, [root, name], "left_anti"))
        if front.isEmpty():
            return seen
        seen = checkpointed(seen.union(front))
    raise RuntimeError(f"closure: longer than {most} steps")
