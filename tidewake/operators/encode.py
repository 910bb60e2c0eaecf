"""Feature encoders: fixed-width arrays of doubles, in a fixed order, built from columns and small arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import clip, local_frame, one_hot

#: Width of the motion features: velocities 6, view and rate 2, state 4, enemy 3, weapon 11.
MOTION = 26


def known(c: Column) -> Column:
    return F.when(c.isNotNull(), 1.0).otherwise(0.0)


def flag(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def motion_features(previous: Column, current: Column, weapons: Sequence[str]) -> Column:
    """26 features of two rows (structs with x y z vx vy vz yaw pitch yaw_rate health armor grounded weapon ex ey ez):
    velocities of both and the enemy's place, in the current view's frame; an unknown enemy is zeros and a zero bit."""
    yaw = current["yaw"]
    now = local_frame(current["vx"], current["vy"], current["vz"], yaw, 320.0)
    was = local_frame(previous["vx"], previous["vy"], previous["vz"], yaw, 320.0)
    enemy = local_frame(current["ex"] - current["x"], current["ey"] - current["y"], current["ez"] - current["z"], yaw, 320.0 * 4)
    state = [current["pitch"] / 90, F.coalesce(clip(current["yaw_rate"] / 180, -4.0, 4.0), F.lit(0.0)), current["health"] / 200, current["armor"] / 200, flag(current["grounded"]), known(current["ex"])]
    parts = [x.cast("double") for x in [*now, *was, *state]] + [F.coalesce(e, F.lit(0.0)).cast("double") for e in enemy]
    return F.concat(F.array(*parts), one_hot(current["weapon"], list(weapons)))


def landmark_features(row: Column, points: Sequence[Column]) -> Column:
    """For each landmark class (its nearest point as a struct x y z, or null) its place in the view's frame / 1280, and an exists bit."""
    out = []
    for p in points:
        near = local_frame(p["x"] - row["x"], p["y"] - row["y"], p["z"] - row["z"], row["yaw"], 1280.0)
        out += [F.coalesce(v, F.lit(0.0)).cast("double") for v in near] + [known(p["x"])]
    return F.array(*out)


def combat_features(row: Column) -> Column:
    """Ammunition, age of the last shot and the enemy's velocity, each with a known bit (zero ammunition is known)."""
    ammo, age = row["ammo"], row["shot_age_ms"]
    enemy = local_frame(row["evx"], row["evy"], row["evz"], row["yaw"], 320.0)
    return F.array(
        F.coalesce(clip(ammo, 0, 1000) / 200, F.lit(0.0)).cast("double"), known(ammo), F.coalesce(clip(age, 0, 10000) / 10000, F.lit(0.0)).cast("double"), known(age),
        *(F.coalesce(v, F.lit(0.0)).cast("double") for v in enemy), known(row["evx"]),
    )


def extra_features(row: Column) -> Column:
    """Ray clear, ray known, enemy in view, eye known, rockets and grenades in sight (at most 20, / 20)."""
    return F.array(*(flag(row[c]) for c in ("clear", "complete", "in_view", "eye_known")), *(F.coalesce(clip(row[c], 0, 20) / 20, F.lit(0.0)).cast("double") for c in ("rockets", "grenades")))


def sequence_step(previous: Column, current: Column, weapons: Sequence[str], points: Sequence[Column]) -> Column:
    """One step: motion 26, extra 6, four for each landmark class, combat 8, and a known bit (97 with 14 classes)."""
    return F.concat(motion_features(previous, current, weapons), extra_features(current), landmark_features(current, points), combat_features(current), F.array(F.lit(1.0)))


def decision_step(previous: Column, current: Column, weapons: Sequence[str], points: Sequence[Column], items: Sequence[Column], packet: Sequence[Column], memory: Column) -> Column:
    """A sequence step, memory (age and known bit of each weapon and item), placements and packet items by class, and
    the weapon frame (351 with 14 landmark and 23 item classes)."""
    frame = current["gunframe"]
    tail = F.array(F.coalesce(clip(frame, 0, 255) / 255, F.lit(0.0)).cast("double"), known(frame))
    return F.concat(sequence_step(previous, current, weapons, points), memory, landmark_features(current, items), landmark_features(current, packet), tail)


def mechanism_step(row: Column, portal: Column, pad: Column) -> Column:
    """26 features of a row and its nearest resolved teleport and push (structs with lx ly lz hx hy hz, and tx ty tz:
    a destination or a launch velocity; null where there is none): local velocity / 1000, view, state, gravity / 800, then
    each mechanism's centre and exit (or launch) in the view's frame with an exists bit, and a known bit."""
    yaw = row["yaw"]
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    own = local_frame(row["vx"], row["vy"], row["vz"], yaw, 1000.0)
    state = [row["pitch"] / 180, F.sin(F.radians(yaw)), F.cos(F.radians(yaw)), row["health"] / 200, row["armor"] / 200, flag(row["grounded"]), flag(row["held"]), row["gravity"] / 800]
    middle = lambda m: local_frame(*((m[f"l{a}"] + m[f"h{a}"]) / 2 - row[a] for a in "xyz"), yaw, 1280.0)
    leave = local_frame(*(portal[f"t{a}"] - row[a] for a in "xyz"), yaw, 1280.0)
    launch = local_frame(*(pad[f"t{a}"] for a in "xyz"), yaw, 1000.0)
    return F.array(
        *map(zero, own), *map(zero, state), *map(zero, middle(portal)), *map(zero, leave), known(portal["lx"]), *map(zero, middle(pad)), *map(zero, launch), known(pad["lx"]), F.lit(1.0)
    )


def standardise(values: Column, mean: Column, std: Column, least: float = 0.05, most: float = 10.0) -> Column:
    """(value - mean) / max(std, least), clipped; mean and std are the training rows'."""
    return F.zip_with(F.zip_with(values, mean, lambda v, m: v - m), std, lambda d, s: F.greatest(F.least(d / F.greatest(s, F.lit(least)), F.lit(most)), F.lit(-most)))
