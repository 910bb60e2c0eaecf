"""Gap-and-island segmentation and stateful row logic as window expressions.

Rows of one key are compared with the row before them (lag on all rows, before any filter); a break starts a new
island, and an island's number is the running sum of breaks. All operators shuffle once, on their key, and share
that exchange and sort when they are chained on the same key and order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import angle_diff, col

#: Named rules for the time between two rows of a key, in milliseconds (low, high), both included.
DT_RULES = {"context": (1, 250), "combat": (100, 100), "transition": (70, 130), "movement": (1, 999)}


def ordered(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order)


def before(c: Column | str, w: WindowSpec, n: int = 1) -> Column:
    return F.lag(col(c), n).over(w)


def add_islands(df: DataFrame, breaks: Column, keys: Sequence[str], order: Sequence[str], name: str = "island") -> DataFrame:
    """df with the number (from 1) of each row's island; breaks (nulls count as true) says whether a row starts a new one.

    breaks may itself use window functions over the same key and order.
    """
    w = ordered(keys, order)
    flagged = df.withColumn("__break", F.when(F.coalesce(breaks, F.lit(True)) | (F.row_number().over(w) == 1), 1).otherwise(0))
    return flagged.withColumn(name, F.sum("__break").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("__break")


def gap_islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, most: int, name: str = "island") -> DataFrame:
    """G1's simplest form: a new island where the time since the row before exceeds most."""
    w = ordered(keys, order)
    return add_islands(df, (F.col(time) - before(time, w)) > most, keys, order, name)


def continuity(w: WindowSpec, time: str, distance: Column, valid: Column, rule: str, per_ms: float | None = None, most: float | None = None) -> Column:
    """Whether a row follows the row before it: the rule's time step, both rows valid, and a step of at most
    per_ms units a millisecond or most units altogether. distance: from the row before, null for the first."""
    low, high = DT_RULES[rule]
    dt = F.col(time) - before(time, w)
    near = distance <= (F.lit(per_ms) * dt if per_ms is not None else F.lit(most))
    return F.coalesce(dt.between(low, high) & valid & before(valid, w) & near, F.lit(False))


def sliding(df: DataFrame, keys: Sequence[str], order: Sequence[str], island: str, size: int, columns: Sequence[str]) -> DataFrame:
    """The last size rows of the island for each row that has as many, as an array history of structs, oldest first."""
    w = W.partitionBy(*keys, island).orderBy(*order)
    rows = F.collect_list(F.struct(*columns)).over(w.rowsBetween(1 - size, 0))
    return df.withColumn("history", rows).where(F.size("history") == size)


def observation_windows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    time: str,
    valid: Column,
    alive: Column,
    continuous: Column,
    payload: Sequence[str],
    context: int = 16,
    horizon: int = 2950,
    anchor_ms: int = 500,
    most_rows: int = 43,
    death_dt: tuple[int, int] = DT_RULES["transition"],
    least_rows: int = 2,
) -> DataFrame:
    """Living anchors with their past and an observed, censored or terminal future.

    valid, alive and continuous are columns of a row (continuous: with the row before it, if both live); rows that are
    not valid break the track. A death within death_dt of a living row ends its island and belongs to it; a corpse
    starts none. Anchors are living rows with time a multiple of anchor_ms and least_rows rows of their island up to
    then. Result: a row per anchor with a non-empty future: keys, order, time, history (context + 1 structs of payload
    at most, oldest first, the anchor last), future (up to and including the first row at horizon or the death; rows
    closer than 70 ms would need a larger most_rows), terminal, complete.
    """
    low, high = death_dt
    w = ordered(keys, [order])
    df = df.withColumn("__ok", F.coalesce(valid, F.lit(False))).withColumn("__alive", F.coalesce(alive, F.lit(False)) & F.col("__ok"))
    df = df.withColumn("__follows", F.coalesce(continuous, F.lit(False)) & F.col("__alive") & F.coalesce(before("__alive", w), F.lit(False)))
    dt = F.col(time) - before(time, w)
    df = df.withColumn("__dies", F.coalesce(before("__alive", w) & F.col("__ok") & ~F.col("__alive") & dt.between(low, high), F.lit(False)))
    df = add_islands(df, ~(F.col("__follows") | F.col("__dies")), keys, [order], "__island")
    df = df.where(F.col("__alive") | F.col("__dies"))
    own = W.partitionBy(*keys, "__island").orderBy(order)
    row = F.struct(*payload, F.col(time).alias("__t"), F.col("__dies"))
    past = F.collect_list(F.struct(*payload)).over(own.rowsBetween(-context, 0))
    ahead = F.collect_list(row).over(own.rowsBetween(1, most_rows))
    out = df.withColumn("history", past).withColumn("__ahead", ahead).withColumn("__n", F.row_number().over(own))
    out = out.where(F.col("__alive") & (F.col("__n") >= least_rows) & (F.col(time) % anchor_ms == 0) & (F.size("__ahead") > 0))
    closes = F.array_position(F.transform("__ahead", lambda r: r["__dies"] | (r["__t"] - F.col(time) >= horizon)), True)
    future = F.when(closes > 0, F.slice("__ahead", F.lit(1), closes.cast("int"))).otherwise(F.col("__ahead"))
    out = out.withColumn("__future", future)
    plain = F.transform("__future", lambda r: F.struct(*(r[c].alias(c) for c in payload)))
    return out.select(*keys, order, time, "history", plain.alias("future"), F.exists("__future", lambda r: r["__dies"]).alias("terminal"), (closes > 0).alias("complete"))


def since_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], island: str, time: str, seen: Column, name: str, most: float | None = None) -> DataFrame:
    """Time since the island's last row (this one included) where seen holds; null and not known if there is none.

    most clips the age; name is the age's column, name_known its bit.
    """
    w = W.partitionBy(*keys, island).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    age = F.col(time) - F.last(F.when(seen, F.col(time)), ignorenulls=True).over(w)
    if most is not None:
        age = F.when(age.isNotNull(), F.greatest(F.least(age, F.lit(most)), F.lit(0)))
    return df.withColumn(name, age).withColumn(f"{name}_known", F.col(name).isNotNull())


def memory(df: DataFrame, keys: Sequence[str], order: Sequence[str], island: str, time: str, value: str, vocabulary: Sequence[str], scale_ms: int = 30_000) -> DataFrame:
    """G7 over a fixed vocabulary: an array of (age / scale, known) for each word, 0 and 0 where it wasn't seen in this life."""
    w = W.partitionBy(*keys, island).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    parts = []
    for word in vocabulary:
        last = F.last(F.when(F.col(value) == word, F.col(time)), ignorenulls=True).over(w)
        age = F.greatest(F.least(F.col(time) - last, F.lit(scale_ms)), F.lit(0)) / scale_ms
        parts += [F.when(last.isNotNull(), age).otherwise(0.0), F.when(last.isNotNull(), 1.0).otherwise(0.0)]
    return df.withColumn("memory", F.array(*parts))


def label_edges(w: WindowSpec, label: Column, valid: Column, time: str, band: tuple[Column, Column], rule: str = "transition") -> Column:
    """The label of a row where it newly appears: changed, positive, within the band [low, high), both rows valid
    and the rule's time step apart; else null. A lingering label and the first row after a gap are no edges."""
    low, high = DT_RULES[rule]
    dt = F.col(time) - before(time, w)
    edge = valid & before(valid, w) & dt.between(low, high) & (label > 0) & (label != before(label, w)) & (label >= band[0]) & (label < band[1])
    return F.when(edge, label)


def deaths(w: WindowSpec, health: str, time: str, rule: str = "transition") -> Column:
    """A row with health 0 or less right after a living one, the rule's time step apart."""
    low, high = DT_RULES[rule]
    return F.coalesce((before(health, w) > 0) & (F.col(health) <= 0) & (F.col(time) - before(time, w)).between(low, high), F.lit(False))


def movement_events(df: DataFrame, keys: Sequence[str], order: str, time: str, x: str, y: str, z: str, vx: str, vy: str, vz: str, grounded: str, held: str) -> DataFrame:
    """A row per movement event: keys, order, time, kind (jump, land, drop, warp, ride), value.

    Rows are all of normal play; a caller breaks a track by another key. A warp (hold flag, or farther than 1.5 units
    a millisecond within a second) ends a fall. A drop is a landing more than 64 below the highest point since the
    ground was left. All of it is one window over the key.
    """
    w = ordered(keys, [order])
    p = lambda c: before(c, w)
    dt = F.col(time) - p(time)
    dx, dy, dz = (F.col(c) - p(c) for c in (x, y, z))
    far = F.sqrt(dx * dx + dy * dy + dz * dz)
    first = p(time).isNull()
    warp = ~first & (F.col(held) | ((dt > 0) & (dt < 1000) & (far > 1.5 * dt)))
    df = df.withColumn("__warp", F.coalesce(warp, F.lit(False))).withColumn("__far", far).withColumn("__pg", p(grounded)).withColumn("__pz", p(z))
    df = df.withColumn("__xy", F.sqrt(dx * dx + dy * dy)).withColumn("__go", ~first & ~F.col("__warp"))
    leaves = F.col("__go") & F.col("__pg") & ~F.col(grounded)
    lands = F.col("__go") & ~F.col("__pg") & F.col(grounded)
    # A fall begins where the ground is left and ends with a landing, a warp or the next start.
    df = df.withColumn("__leaves", F.coalesce(leaves, F.lit(False))).withColumn("__lands", F.coalesce(lands, F.lit(False)))
    df = df.withColumn("__stop", F.col("__leaves") | F.col("__warp"))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("__air", F.sum(F.col("__stop").cast("int")).over(upto))
    fall = W.partitionBy(*keys, "__air").orderBy(order)
    began = F.first("__leaves").over(fall.rowsBetween(W.unboundedPreceding, 0))
    earlier = F.coalesce(F.max(F.col("__lands").cast("int")).over(fall.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 0
    top = F.greatest(F.first("__pz").over(fall.rowsBetween(W.unboundedPreceding, 0)), F.coalesce(F.max(F.when(~F.col("__leaves"), F.col(z))).over(fall.rowsBetween(W.unboundedPreceding, -1)), F.first("__pz").over(fall.rowsBetween(W.unboundedPreceding, 0))))
    df = df.withColumn("__fell", F.when(F.col("__lands") & began & earlier, top - F.col(z)))
    speed = F.sqrt(F.col(vx) * F.col(vx) + F.col(vy) * F.col(vy))
    event = lambda when, kind, value: F.when(when, F.struct(F.lit(kind).alias("kind"), value.cast("double").alias("value")))
    events = F.array(
        event(F.col("__warp"), "warp", F.col("__far")),
        event(F.col("__go") & F.col(grounded) & F.col("__pg") & (F.col("__xy") > 8) & (speed < 20), "ride", F.col("__xy")),
        event(F.col("__leaves") & (F.col(vz) > 100), "jump", F.col(vz)),
        event(F.col("__lands"), "land", F.lit(0.0)),
        event(F.col("__fell") > 64, "drop", F.col("__fell")),
    )
    out = df.select(*keys, order, time, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))
    return out.select(*keys, order, time, "e.kind", "e.value")


def runs_of(df: DataFrame, keys: Sequence[str], time: str, step: int, size: int, every: int, payload: Sequence[str]) -> DataFrame:
    """Arrays of size consecutive rows exactly step apart, for rows whose time is a multiple of every."""
    w = ordered(keys, [time])
    df = add_islands(df, (F.col(time) - before(time, w)) != step, keys, [time], "__run")
    return sliding(df, keys, [time], "__run", size, payload).where(F.col(time) % every == 0).drop("__run")


def rates(df: DataFrame, keys: Sequence[str], order: str, time: str, yaw: str, pitch: str, vx: str, vy: str, grounded: str, valid: Column, follows: Column) -> DataFrame:
    """Turn rates, yaw acceleration, horizontal acceleration, air speed gain, heading against view, jump candidates.

    follows: whether a row continues the row before it; other rows are dropped, and the second-order rate needs two of
    them in a row. Rates are per second.
    """
    w = ordered(keys, [order])
    sec = (F.col(time) - before(time, w)) / F.lit(1000.0)
    speed = lambda a, b: F.sqrt(a * a + b * b)
    df = df.withColumn("__valid", valid)
    df = df.withColumn("__f", F.coalesce(follows & F.col("__valid"), F.lit(False))).withColumn("__sec", sec)
    df = df.withColumn("yaw_rate", F.when(F.col("__f"), angle_diff(yaw, before(yaw, w)) / F.col("__sec")))
    df = df.withColumn("pitch_rate", F.when(F.col("__f"), angle_diff(pitch, before(pitch, w)) / F.col("__sec")))
    df = df.withColumn("yaw_accel", F.when(F.col("__f") & before("__f", w), (F.col("yaw_rate") - before("yaw_rate", w)) / ((F.col("__sec") + before("__sec", w)) * 0.5)))
    now, was = speed(F.col(vx), F.col(vy)), speed(before(vx, w), before(vy, w))
    df = df.withColumn("speed_xy", now)
    df = df.withColumn("accel_xy", speed(F.col(vx) - before(vx, w), F.col(vy) - before(vy, w)) / F.col("__sec"))
    df = df.withColumn("air_speed_gain", F.when(~F.col(grounded) & ~before(grounded, w), now - was))
    df = df.withColumn("heading_view_delta", F.when(now > 20, angle_diff(F.degrees(F.atan2(F.col(vy), F.col(vx))), yaw)))
    df = df.withColumn("__pg", before(grounded, w))
    return df.where("__f").drop("__f", "__sec", "__valid")


def jump_candidate(df: DataFrame, vz: str, grounded: str) -> DataFrame:
    """G13 for the result of rates(): on the ground before, in the air now, going up."""
    return df.withColumn("jump_candidate", F.col("__pg") & ~F.col(grounded) & (F.col(vz) > 0)).drop("__pg")
