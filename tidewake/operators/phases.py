"""Match phases, identities, scores and modes: state machines as change points and running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Confidence codes of an epoch's start.
UNKNOWN, INFERRED, AUTHORITATIVE = 0, 1, 2


def phase_of(status: Column) -> Column:
    """A status text's phase; Match End is asked before Match. Null for other texts: they change nothing."""
    s = F.lower(status)
    return F.when(s.startswith("warmup") | s.startswith("countdown"), "prelive").when(s.startswith("match end"), "post").when(s.startswith("match") | s.startswith("overtime"), "live")


def epochs(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, phase: Column) -> DataFrame:
    """A row per live epoch: keys, epoch_id (from 1), start_ms, end_ms (the first row after it, null if it stays
    open), start_conf, closed. A key that is live from its first known phase on was entered midway: its start is inferred.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("phase", phase).where("phase IS NOT NULL")
    d = d.withColumn("was", F.lag("phase").over(w)).where("was IS NULL OR was <> phase")
    d = d.withColumn("end_ms", F.lead(time).over(w)).where("phase = 'live'")
    d = d.withColumn("epoch_id", F.row_number().over(w).cast("long"))
    conf = F.when(F.col("was").isNull(), INFERRED).otherwise(AUTHORITATIVE)
    return d.select(*keys, "epoch_id", F.col(time).alias("start_ms"), "end_ms", conf.alias("start_conf"), F.col("end_ms").isNotNull().alias("closed"))


def implicit_epochs(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """G15 without phases: one epoch per key over all of its rows, its start unknown."""
    return df.groupBy(*keys).agg(F.min(time).alias("start_ms"), F.max(time).alias("end_ms")).withColumn("start_conf", F.lit(UNKNOWN))


def identity_tracks(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, alias: str, released: Column, most: int = 4) -> DataFrame:
    """A row per occupant of a slot: keys, track (from 1), start_ms, identity_end_ms (0: open), aliases.

    A released row (empty name) ends the track; the next named row starts a new one. aliases are the first distinct
    ones in the order they were seen, at most most.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("__free", F.coalesce(released, F.lit(True)))
    d = d.withColumn("__starts", ~F.col("__free") & F.coalesce(F.lag("__free").over(w), F.lit(True)))
    d = d.withColumn("track", F.sum(F.col("__starts").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).where("track > 0")
    own = [*keys, "track"]
    ends = F.min(F.when(F.col("__free"), F.col(time)))
    base = d.groupBy(*own).agg(F.min(time).alias("start_ms"), F.coalesce(ends, F.lit(0)).alias("identity_end_ms"))
    names = d.where(~F.col("__free")).groupBy(*own, alias).agg(F.min(F.struct(*order)).alias("__first"))
    names = names.withColumn("__rn", F.row_number().over(W.partitionBy(*own).orderBy("__first", alias))).where(F.col("__rn") <= most)
    names = names.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rn", alias))), lambda x: x[alias]).alias("aliases"))
    return base.join(names, own)


def score_timeline(df: DataFrame, keys: Sequence[str], order: Sequence[str], score: str) -> DataFrame:
    """Baseline, final, least and greatest score, changes, the sum of rises (earned) and of falls (penalties)."""
    w = W.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("__d", F.col(score) - F.lag(score).over(w))
    return d.groupBy(*keys).agg(
        F.min_by(score, F.struct(*order)).alias("baseline"),
        F.max_by(score, F.struct(*order)).alias("final"),
        F.min(score).alias("least"),
        F.max(score).alias("greatest"),
        F.count(F.when(F.col("__d") != 0, 1)).alias("changes"),
        F.coalesce(F.sum(F.when(F.col("__d") > 0, F.col("__d"))), F.lit(0)).alias("earned"),
        F.coalesce(F.sum(F.when(F.col("__d") < 0, -F.col("__d"))), F.lit(0)).alias("penalties"),
    )


def pickup_counts(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str, name: Column, health: str, groups: Sequence[str]) -> DataFrame:
    """Counts of new or changed labels by item name; Health with a rise of 50 or more counts as Mega Health."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = (F.col(label) > 0) & ((F.lag(label).over(w) != F.col(label)) | F.lag(label).over(w).isNull())
    mega = (F.lower(name) == "health") & (F.col(health) - F.lag(health).over(w) >= 50)
    d = df.withColumn("__new", F.coalesce(new, F.lit(False))).withColumn("item", F.when(F.coalesce(mega, F.lit(False)), "Mega Health").otherwise(name))
    return d.where(F.col("__new") & F.col("item").isNotNull()).groupBy(*groups, "item").agg(F.count("*").alias("n"))


def boards(epochs_: DataFrame, layouts: DataFrame, keys: Sequence[str], epoch: str, start: str, end: str, layout: str, time: str, within: int = 10_000) -> DataFrame:
    """Each epoch's final table: the last layout shown in it, else the first within so long after its end; with a reason
    where there is none. A layout after the next epoch's start belongs to none before it."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(start)
    e = epochs_.select(*keys, epoch, start, end).withColumn("__until", F.least(F.col(end) + within, F.coalesce(F.lead(start).over(w) - 1, F.col(end) + within)))
    l = layouts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(layout).alias("__layout"), F.col(time).alias("__t"))  # noqa: E741
    cond = F.col("__t").between(F.col(start), F.col("__until"))
    for k in keys:
        cond &= F.col(k) == F.col(f"__{k}")
    met = e.join(l, cond, "left")
    inside = F.col("__t") <= F.col(end)
    out = met.groupBy(*keys, epoch).agg(F.max(F.when(inside, F.struct("__t", "__layout"))).alias("a"), F.min(F.when(~inside, F.struct("__t", "__layout"))).alias("b"))
    chosen = F.coalesce(F.col("a.__layout"), F.col("b.__layout"))
    reason = F.when(F.col("a").isNotNull(), "before_end").when(F.col("b").isNotNull(), "after_end").otherwise("no_table")
    return out.select(*keys, epoch, chosen.alias("layout"), reason.alias("reason"))


def results(df: DataFrame, match: Sequence[str], score: str, team: str | None = None) -> DataFrame:
    """Win for the one best score of a match, draw for several, loss for others; with teams the two teams' totals
    decide, and rows of no team (1 or 2) are unknown."""
    w = W.partitionBy(*match)
    if team is None:
        best = F.max(score).over(w)
        d = df.withColumn("__best", best).withColumn("__ties", F.sum((F.col(score) == best).cast("int")).over(w))
        return d.withColumn("result", F.when(F.col(score) != F.col("__best"), "loss").when(F.col("__ties") > 1, "draw").otherwise("win")).drop("__best", "__ties")
    total = lambda t: F.coalesce(F.sum(F.when(F.col(team) == t, F.col(score))).over(w), F.lit(0))
    mine, other = F.when(F.col(team) == 1, total(1)).otherwise(total(2)), F.when(F.col(team) == 1, total(2)).otherwise(total(1))
    known = F.col(team).isin(1, 2)
    return df.withColumn("result", F.when(~F.coalesce(known, F.lit(False)), "unknown").when(mine > other, "win").when(mine < other, "loss").otherwise("draw"))


def modes(df: DataFrame, adapter: str, teams_seen: str, players: str) -> DataFrame:
    """A segment's mode and how sure it is, by adapter, teams and the number that scored or is on the table."""
    t, n, a = F.col(teams_seen), F.col(players), F.col(adapter)
    generic = F.when(t, "tdm").when(n == 2, "duel").when(n > 2, "ffa").otherwise("unknown")
    mode = F.when(a == "team_mod", F.when(t & (n > 2), "tdm").otherwise("duel")).when(a == "ffa_mod", "ffa").otherwise(generic)
    conf = F.when(a == "ffa_mod", AUTHORITATIVE).when((a != "team_mod") & (mode == "unknown"), UNKNOWN).otherwise(INFERRED)
    return df.withColumn("mode", mode).withColumn("mode_conf", conf)


def unique_name(rows: DataFrame, names: DataFrame, on: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Rows with the columns take of the one namesake; status found, missing or ambiguous."""
    n = F.count("*")
    one = names.groupBy(*on).agg(*(F.when(n == 1, F.first(c)).alias(c) for c in take), n.alias("__n"))
    out = rows.join(one, list(on), "left")
    return out.withColumn("status", F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "ambiguous").otherwise("found")).drop("__n")


def spans(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """First and last time of each key and what lies between."""
    return df.groupBy(*keys).agg(F.min(time).alias("first_ms"), F.max(time).alias("last_ms")).withColumn("duration_ms", F.col("last_ms") - F.col("first_ms"))
