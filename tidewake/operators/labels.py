"""Targets from observed futures. A mask says whether a label is known; what was censored is never a negative."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import local_frame


def first_within(future: Column, time: Column, low: int, high: int, ok=None) -> Column:
    """The first row of a future within [low, high] after time (that ok holds for); null without one."""
    inside = lambda r: (r["time_ms"] - time).between(low, high) & (ok(r) if ok else F.lit(True))
    return F.get(F.filter(future, inside), F.lit(0))


def velocity_soon(future: Column, time: Column, yaw: Column, low: int = 270, high: int = 330) -> Column:
    """L1: the velocity of the first living row 300 ms on, in the frame of the current view, in units of 320; null if unknown."""
    r = first_within(future, time, low, high, lambda x: x["health"] > 0)
    return F.when(r.isNotNull(), F.array(*local_frame(r["vx"], r["vy"], r["vz"], yaw, 320.0)))


def displacement(future: Column, now: Column, yaw: Column, low: int = 2950, high: int = 3050) -> Column:
    """L2: displacement in the view's frame in units of 1280, and change of health / 100 and armor / 200, of a living row 3 s on."""
    r = first_within(future, now["time_ms"], low, high, lambda x: x["health"] > 0)
    moved = local_frame(r["x"] - now["x"], r["y"] - now["y"], r["z"] - now["z"], yaw, 1280.0)
    return F.when(r.isNotNull(), F.array(*moved, (r["health"] - now["health"]) / 100, (r["armor"] - now["armor"]) / 200))


def _steps(now: Column, future: Column) -> Column:
    own = lambda r: F.struct(r["health"].cast("long").alias("h"), r["armor"].cast("long").alias("a"))
    ahead = F.transform(future, own)
    before = F.slice(F.concat(F.array(own(now)), ahead), F.lit(1), F.size(future))
    return F.zip_with(before, ahead, lambda a, b: F.struct(a["h"].alias("h0"), a["a"].alias("a0"), b["h"].alias("h1"), b["a"].alias("a1")))


def stack_loss(now: Column, future: Column) -> Column:
    """L3: the sum of all drops of health (not below 0) and armor along the chain; gains don't make up for them."""
    zero = F.lit(0).cast("long")
    drop = lambda s: F.greatest(s["h0"] - F.greatest(s["h1"], F.lit(0)), F.lit(0)) + F.greatest(s["a0"] - s["a1"], F.lit(0))
    return F.aggregate(_steps(now, future), zero, lambda acc, s: acc + drop(s).cast("long"))


def any_gain(now: Column, future: Column) -> Column:
    """L3: whether health or armor rises anywhere along the chain."""
    return F.exists(_steps(now, future), lambda s: (s["h1"] > s["h0"]) | (s["a1"] > s["a0"]))


def event_labels(now: Column, future: Column, loss: int = 20, low: int = 2950, high: int = 3050) -> Column:
    """L3: struct of death, loss, gain and their masks: known if it happened, or if the future is complete."""
    death = F.exists(future, lambda r: r["health"] <= 0)
    complete = death | first_within(future, now["time_ms"], low, high, lambda x: x["health"] > 0).isNotNull()
    lost, gained = stack_loss(now, future) >= loss, any_gain(now, future)
    return F.struct(
        death.alias("death"), lost.alias("loss"), gained.alias("gain"), (death | complete).alias("death_known"), (lost | complete).alias("loss_known"), (gained | complete).alias("gain_known")
    )


def next_pickup(future: Column, time: Column, none: str = "none", horizon: int = 2950) -> Column:
    """L4: the first picked item; none only if the future is complete and every row of it could have shown one; else null."""
    picked = F.get(F.filter(future, lambda r: r["pickup"].isNotNull()), F.lit(0))
    last = F.try_element_at(future, F.lit(-1))
    complete = (last["health"] <= 0) | (last["time_ms"] - time >= horizon)
    seen = F.forall(future, lambda r: F.coalesce(r["pickup_known"], F.lit(False)) | (r["health"] <= 0))
    return F.when(picked.isNotNull(), picked["pickup"]).when((F.size(future) > 0) & complete & seen, F.lit(none))


def mechanism_labels(future: Column, now: Column, low: int = 970, high: int = 1030) -> Column:
    """Struct of teleport and push within the future (rows with an edge kind), their masks as in event_labels, and the
    displacement and velocity of a living row 1 s on, in the view's frame; null where it wasn't seen."""
    end = first_within(future, now["time_ms"], low, high, lambda x: x["health"] > 0)
    complete = end.isNotNull() | F.exists(future, lambda r: r["health"] <= 0)
    moved = local_frame(*(end[a] - now[a] for a in "xyz"), now["yaw"], 1280.0)
    speed = local_frame(end["vx"], end["vy"], end["vz"], now["yaw"], 1000.0)
    did = lambda k: F.exists(future, lambda r: r["edge"] == k)
    return F.struct(
        did("teleport").alias("teleport"), did("push").alias("push"), (did("teleport") | complete).alias("teleport_known"), (did("push") | complete).alias("push_known"),
        F.when(end.isNotNull(), F.array(*moved, *speed)).alias("y"),
    )


def any_known(*masks: Column) -> Column:
    """Whether a sample knows anything."""
    out = F.lit(False)
    for m in masks:
        out |= F.coalesce(m, F.lit(False))
    return out
