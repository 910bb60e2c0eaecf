"""Verdicts over recordings and runs: ingestion ladders, tracks of shots, first-named targets, continual runs, pins and corrected scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .aggregates import class_weights, switch_factor
from .filters import first_reason

# The weapons that a death can be counted for.
COUNTED_WEAPONS = (
    "blaster", "shotgun", "super_shotgun", "machinegun", "chaingun", "grenades", "grenade_launcher", "rocket_launcher", "hyperblaster", "railgun", "bfg10k",
)


def ingest_verdict(code: Column, unsupported: Column, truncated: Column, too_long: Column, mismatch: Column, segments: Column, have_map: Column, samples: Column, cells: Column) -> Column:
    """Why a recording isn't taken, or ok: named reasons come before the general one (a stream that is unsupported stops
    with a format error too). code is ok, open, truncated, format or any other failure."""
    rules = [
        ("open", code == "open"),
        ("unsupported", unsupported),
        ("truncated", truncated | (code == "truncated")),
        ("format", code == "format"),
        ("unsupported", code != "ok"),
        ("provenance_too_long", too_long),
        ("map_mismatch", mismatch),
        ("ambiguous", (segments > 1) & ~have_map),
        ("no_pov", samples == 0),
        ("empty", cells == 0),
    ]
    return F.coalesce(first_reason(rules), F.lit("ok"))


def recording_maps(names: DataFrame, recording: str, order: str, name: str, expected: Column | None = None) -> DataFrame:
    """(recording, map, mismatch): the first map that a recording names; mismatch if it names another one, whatever
    the case, or not the expected one."""
    wrong = F.countDistinct(F.lower(name)) > 1
    if expected is not None:
        wrong |= F.bool_or(F.lower(name) != F.lower(expected))
    return names.where(F.col(name).isNotNull()).groupBy(recording).agg(F.min_by(name, order).alias("map"), wrong.alias("mismatch"))


def shot_tracks(shots: DataFrame, keys: Sequence[str], epoch: str, order: str) -> DataFrame:
    """Shots numbered from 0 by order within (keys, epoch). A shot without an epoch is an error: its source is out of date."""
    known = F.when(F.col(epoch).isNotNull(), F.col(epoch)).otherwise(F.raise_error(F.lit("a shot has no epoch: import its recording again")))
    return shots.withColumn(epoch, known).withColumn("shot", F.row_number().over(W.partitionBy(*keys, epoch).orderBy(order)) - 1)


def first_named(sources: DataFrame, targets: DataFrame, source_name: str, target_name: str, order: str, take: Sequence[str], on: Sequence[str] = ()) -> DataFrame:
    """Sources with the columns take of the first target (by order) of that name; nulls without one. Unlike J11 more than one is no doubt."""
    named = targets.where(F.coalesce(F.col(target_name) != "", F.lit(False)))
    first = named.groupBy(*on, F.col(target_name).alias(source_name)).agg(F.min_by(F.struct(*take), order).alias("__t"))
    out = sources.join(first, [*on, source_name], "left")
    return out.select(*sources.columns, *(F.col(f"__t.{c}").alias(c) for c in take))


def weapon_counts(deaths: DataFrame, groups: Sequence[str], weapon: str) -> DataFrame:
    """Deaths by weapon; those of a weapon that isn't known count nowhere."""
    return deaths.where(F.col(weapon).isin(*COUNTED_WEAPONS)).groupBy(*groups, weapon).agg(F.count("*").alias("n"))


def within_segment(df: DataFrame, recording: str, order: str, opens: Column, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Df with segment (from 0, a row that opens one is its first) and name, the last value that was told for the keys
    in the same segment: a new segment starts from nothing."""
    df = df.withColumn("segment", F.sum(F.when(opens, 1).otherwise(0)).over(W.partitionBy(recording).orderBy(order)))
    w = W.partitionBy(recording, "segment", *keys).orderBy(order)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def pair_report(groups: DataFrame, group: str, split: str) -> DataFrame:
    """Per split its matches and distinct pairs (a match without a pair is in none), with the pairs of all splits."""
    everything = groups.agg(F.countDistinct(group).alias("unique_pairs"))
    by = groups.groupBy(split).agg(F.count("*").alias("matches"), F.countDistinct(group).alias("pairs"))
    return by.join(F.broadcast(everything))  # one row


def continual_runs(runs: DataFrame, keys: Sequence[str], order: str, accepted: Column) -> DataFrame:
    """The runs up to and with the first one that is rejected: what comes behind isn't trained."""
    refused = F.sum(F.when(accepted, 0).otherwise(1)).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return runs.withColumn("accepted", accepted).withColumn("__refused", F.coalesce(refused, F.lit(0))).where("__refused = 0").drop("__refused")


def missing_splits(df: DataFrame, by_map: str, split: str, wanted: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """(map, missing): the wanted splits, sorted, that a map has no row of; maps that have all aren't told."""
    have = df.groupBy(by_map).agg(F.collect_set(F.when(F.col(split).isin(*wanted), F.col(split))).alias("have"))
    return have.select(by_map, F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, wanted)), "have")), ",").alias("missing")).where("missing <> ''")


def changed_pins(pinned: DataFrame, now: DataFrame, key: str, value: str) -> DataFrame:
    """(key, was, is) where a stored contract and the present one differ; any row means that a new output is due."""
    met = pinned.select(key, F.col(value).alias("was")).join(now.select(key, F.col(value).alias("is")), key, "full_outer")
    return met.where(~F.col("was").eqNullSafe(F.col("is")))


def corrected_choice(rows: DataFrame, training: DataFrame, logits: str, label: str, current: str) -> DataFrame:
    """Rows with choice, the class (from 0) of the greatest logit after the training's emphasis is taken back: its
    class weights (label) and, for classes other than the current one, its switch factor. training is another table than rows.

    Of equal classes the least is chosen; a class that training doesn't know keeps its logit.
    """
    weights = class_weights(training, label).agg(F.map_from_entries(F.collect_list(F.struct(label, "weight"))).alias("__w"))
    factor = switch_factor(training, label, current).select(F.col("factor").alias("__f"))
    d = rows.join(F.broadcast(weights)).join(F.broadcast(factor))  # one row each
    away = lambda i: F.when((F.col(current) >= 0) & (F.col(current) != i), F.log("__f")).otherwise(F.lit(0.0))
    moved = F.transform(logits, lambda z, i: z - F.log(F.coalesce(F.try_element_at("__w", i), F.lit(1.0))) - away(i))
    return d.withColumn("choice", F.array_position(moved, F.array_max(moved)).cast("int") - 1).drop("__w", "__f")
