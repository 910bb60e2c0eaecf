"""Queries of mechanisms, encoders, maps and rulings over the frames of track.py, with their DuckDB counterparts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.scoreboard import scoreboard
from ..functions.text import ITEMS, WEAPONS
from ..operators import encode, filters, geometry, labels, rulings
from ..sources import datasets, demos, files, maps, records
from ..sources import frames as recorded
from .track import CTE, frames
from .trajectory import LAG, alive, ground, hold, track

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

C = F.col


def query(sql: str, start: str = CTE):
    """Registers a query of this module's name for it; sql follows the frames' expression t."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, f"{start} {sql}"
        return f

    return add


def tidy(c, digits=6):
    return F.round(c, digits) + 0.0


def _tidy(sql):
    return f"ROUND({sql}, 6) + 0e0"


def _local(x, y, yaw, scale):
    """SQL: the first two components in the frame that looks along yaw."""
    return _tidy(f"(({x}) * COS(RADIANS({yaw})) + ({y}) * SIN(RADIANS({yaw}))) / {scale}"), _tidy(f"(-({x}) * SIN(RADIANS({yaw})) + ({y}) * COS(RADIANS({yaw}))) / {scale}")


def _slab(start, end, low, high):
    """SQL: whether a segment meets a box."""
    ways = [(f"({e} - {s})", s, lo, hi) for s, e, lo, hi in zip(start, end, low, high)]
    enter = ", ".join(f"CASE WHEN ABS({d}) < 1e-9 THEN 0 ELSE LEAST(({lo} - {s}) / {d}, ({hi} - {s}) / {d}) END" for d, s, lo, hi in ways)
    leave = ", ".join(f"CASE WHEN ABS({d}) < 1e-9 THEN 1 ELSE GREATEST(({lo} - {s}) / {d}, ({hi} - {s}) / {d}) END" for d, s, lo, hi in ways)
    flat = " AND ".join(f"(ABS({d}) >= 1e-9 OR ({s} >= {lo} AND {s} <= {hi}))" for d, s, lo, hi in ways)
    return f"(GREATEST(0, {enter}) <= LEAST(1, {leave}) AND {flat})"


@query("SELECT seq, v AS valid, v AND health > 0 AND (flags // 32) % 2 = 0 AS moving FROM (SELECT *, k % 4 <> 0 AND k % 17 <> 0 AND k % 10 <> 0 AND k % 7 <> 0 AND k % 11 <> 0 AS v FROM t) u")
def actor_predicates(spark, sf):
    """rows of actors in play, and of those that move."""
    bit = lambda n: F.when(C("k") % n == 0, 1).otherwise(0)
    stats = F.array(F.lit(0), C("health").cast("int"), *[F.lit(0)] * 14, bit(10), bit(7))
    d = frames(spark, sf).withColumn("stats", F.when(C("k") % 17 == 0, F.slice(stats, 1, 17)).otherwise(stats)).withColumn("pm_type", bit(4))
    d = d.withColumn("place", F.array("x", "y", F.when(C("k") % 11 == 0, F.lit(float("nan"))).otherwise(C("z"))))
    return d.select("seq", filters.actor_valid("pm_type", "stats", "place").alias("valid"), filters.actor_moving("pm_type", "stats", "flags", "place").alias("moving"))


@query(", s AS (SELECT DISTINCT rec, rec % 7 AS m FROM t) SELECT rec, rec % 3 <> 0 AND rec % 5 <> 0 AND rec % 11 <> 0 AND m NOT IN (0, 1, 2) AS skip FROM s")
def skipped_scans(spark, sf):
    """recordings whose clean scan names none of the wanted maps."""
    scans = frames(spark, sf).select("rec").distinct()
    bit = lambda n: F.when(C("rec") % n == 0, 1).otherwise(0)
    names = F.when(C("rec") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("m"), (C("rec") % 7).cast("string"))))
    scans = scans.select("rec", bit(3).alias("code"), bit(5).alias("quality"), names.alias("maps"), (C("rec") % 11 != 0).alias("complete"))
    return filters.can_skip(scans, ["m1", "m2"], "code", "quality", "maps", "complete").select("rec", "skip")


@query("SELECT rec, 'm' || label AS map, COUNT(*) AS n FROM t WHERE label IN (2, 4) GROUP BY rec, label")
def wanted_segments(spark, sf):
    """segments on one of the wanted maps."""
    d = frames(spark, sf).groupBy("rec", F.concat(F.lit("m"), C("label").cast("string")).alias("map")).agg(F.count("*").alias("n"))
    return filters.wanted_maps(d, ["m2", "m4"])


@query("SELECT seq, CASE WHEN d > 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END + 0e0 AS folded FROM (SELECT seq, (yaw - pitch * 4) % 360 AS d FROM t) u")
def folded_angles(spark, sf):
    """M2: differences of angles, folded after a truncated modulus."""
    return frames(spark, sf).select("seq", (S.angle_diff_folded("yaw", C("pitch") * 4) + 0.0).alias("folded"))


@query(f"""SELECT seq, CASE WHEN p = 0 AND y IN (-1, -2, 0) THEN 0e0 ELSE {_tidy("COS(RADIANS(p)) * COS(RADIANS(y))")} END AS dx, CASE WHEN p = 0 AND y IN (-1, -2, 0) THEN 0e0 ELSE {_tidy("COS(RADIANS(p)) * SIN(RADIANS(y))")} END AS dy,
 CASE WHEN p = 0 AND y = -1 THEN 1e0 WHEN p = 0 AND y = -2 THEN -1e0 WHEN p = 0 AND y = 0 THEN 0e0 ELSE {_tidy("-SIN(RADIANS(p))")} END AS dz
FROM (SELECT seq, CASE WHEN k % 5 < 3 THEN 0 ELSE pitch END AS p, CASE k % 5 WHEN 0 THEN -1 WHEN 1 THEN -2 WHEN 2 THEN 0 ELSE yaw END AS y FROM t) u""")
def push_directions(spark, sf):
    """M8: directions of launch volumes, with the three special angles."""
    k = C("k") % 5
    d = frames(spark, sf).select("seq", F.when(k < 3, 0.0).otherwise(C("pitch")).alias("p"), F.when(k == 0, -1.0).when(k == 1, -2.0).when(k == 2, 0.0).otherwise(C("yaw")).alias("w"))
    return d.select("seq", *(tidy(c).alias(n) for n, c in zip(("dx", "dy", "dz"), S.push_direction(C("p"), C("w"), F.lit(0.0)))))


@query(f"SELECT seq, {_tidy('x / 100 - LN(0.5)')} AS z0, {_tidy('y / 10 - LN(1.0) - LN(3.0)')} AS z1, {_tidy('z / 10 - LN(2.0) - (k % 2) * LN(3.0)')} AS z2 FROM t")
def corrected_logits(spark, sf):
    """Logits without the weights of training."""
    d = frames(spark, sf).withColumn("l", F.array(C("x") / 100, C("y") / 10, C("z") / 10))
    d = d.withColumn("c", S.corrected(C("l"), F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(1.0), (C("k") % 2).cast("double")), 3.0))
    return d.select("seq", *(tidy(F.get("c", i)).alias(f"z{i}") for i in range(3)))


def _ahead(spark, sf, most, every, *fields):
    """Living rows at multiples of every with the rows of the next most milliseconds."""
    w = W.partitionBy("rec").orderBy("time_ms").rangeBetween(1, most)
    d = frames(spark, sf)
    d = d.withColumn("pickup", F.when(C("event_type") == "purchase", F.concat(F.lit("item"), C("label").cast("string")))).withColumn("pickup_known", C("k") % 9 != 0)
    d = d.withColumn("edge", F.when(C("event_type") == "view", "teleport").when(C("event_type") == "signup", "push").otherwise("ordinary"))
    d = d.withColumn("future", F.collect_list(F.struct("time_ms", "health", *fields)).over(w))
    return d.where(alive() & (C("time_ms") % every == 0) & (F.size("future") > 0))


@query(""", f AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'item' || label END AS pickup, k % 9 <> 0 AS seen FROM t)
, j AS (SELECT a.seq, a.time_ms AS t0, ARG_MIN(b.pickup, b.time_ms) FILTER (WHERE b.pickup IS NOT NULL) AS pickup, MAX(b.time_ms) AS t1, ARG_MAX(b.health, b.time_ms) AS h1, BOOL_AND(b.seen OR b.health <= 0) AS seen
  FROM f a JOIN f b ON a.rec = b.rec AND b.time_ms BETWEEN a.time_ms + 1 AND a.time_ms + 3000 WHERE a.time_ms % 500 = 0 AND a.health > 0 GROUP BY a.seq, a.time_ms)
SELECT seq, COALESCE(pickup, CASE WHEN (h1 <= 0 OR t1 - t0 >= 2950) AND seen THEN 'none' END) AS label FROM j""")
def pickup_labels(spark, sf):
    """L4: the next pickup, none where all of a complete future shows none, else unknown."""
    d = _ahead(spark, sf, 3000, 500, "pickup", "pickup_known")
    return d.select("seq", labels.next_pickup(C("future"), C("time_ms")).alias("label"))


@query(f""", f AS (SELECT *, CASE event_type WHEN 'view' THEN 'teleport' WHEN 'signup' THEN 'push' ELSE 'ordinary' END AS edge FROM t)
, j AS (SELECT a.seq, a.rec, a.x AS ax, a.y AS ay, a.yaw AS w, BOOL_OR(b.edge = 'teleport') AS teleport, BOOL_OR(b.edge = 'push') AS push, BOOL_OR(b.health <= 0) AS died,
   MIN(b.time_ms) FILTER (WHERE b.health > 0 AND b.time_ms - a.time_ms BETWEEN 970 AND 1030) AS te
  FROM f a JOIN f b ON a.rec = b.rec AND b.time_ms BETWEEN a.time_ms + 1 AND a.time_ms + 1030 WHERE a.time_ms % 300 = 0 AND a.health > 0 GROUP BY a.seq, a.rec, a.x, a.y, a.yaw)
SELECT j.seq, teleport, push, teleport OR died OR te IS NOT NULL AS teleport_known, push OR died OR te IS NOT NULL AS push_known, {_local("e.x - ax", "e.y - ay", "w", 1280)[0]} AS y0, {_local("e.vx", "e.vy", "w", 1000)[1]} AS y4, {_tidy("e.vz / 1000")} AS y5
FROM j LEFT JOIN f e ON e.rec = j.rec AND e.time_ms = te""")
def mechanism_targets(spark, sf):
    """Teleports and pushes within a second, and where and how fast the actor then is."""
    d = _ahead(spark, sf, 1030, 300, "x", "y", "z", "vx", "vy", "vz", "edge")
    d = d.withColumn("m", labels.mechanism_labels(C("future"), F.struct("time_ms", "x", "y", "z", "yaw")))
    return d.select("seq", "m.teleport", "m.push", "m.teleport_known", "m.push_known", *(tidy(F.get("m.y", i)).alias(f"y{i}") for i in (0, 4, 5)))


def _mechanism_rows():
    """Teleports (two to a destination) and pushes along the frames' way, by rule."""
    rows = [(i, "teleport", [80.0 * i, -100.0, -100.0], [80.0 * i + 80, 200.0, 200.0], [80.0 * i + 40, 20.0, 60.0], None, i // 2) for i in range(30)]
    return rows + [(100 + i, "push", [240.0 * i, -100.0, -100.0], [240.0 * i + 200, 200.0, 200.0], None, [80.0 * (i % 8) - 150, 60.0 * (i % 5 - 2), 60.0 * (i % 3 - 1)], None) for i in range(10)]


_VALUES = ", ".join("(" + ", ".join([str(i), f"'{kind}'", *map(repr, low), *map(repr, high), *map(repr, to or v), "NULL" if d is None else str(d)]) + ")" for i, kind, low, high, to, v, d in _mechanism_rows())


def _hull(start, end, pad):
    return _slab([f"{a}" for a in start], [f"{a}" for a in end], [f"(l{a} - {h + pad})" for a, h in zip("xyz", (16, 16, 32))], [f"(h{a} + {h + pad})" for a, h in zip("xyz", (16, 16, 24))])


_P, _AHEAD, _NOW = ("px", "py", "pz"), ("fx", "fy", "fz"), ("x", "y", "z")
_FAR = lambda a, b: "SQRT(" + " + ".join(f"({x} - {y}) * ({x} - {y})" for x, y in zip(a, b)) + ")"
_T = ("tx", "ty", "tz")
EDGES = f"""{LAG}, m(id, kind, lx, ly, lz, hx, hy, hz, tx, ty, tz, dest) AS (SELECT col0, col1, CAST(col2 AS DOUBLE), CAST(col3 AS DOUBLE), CAST(col4 AS DOUBLE), CAST(col5 AS DOUBLE), CAST(col6 AS DOUBLE), CAST(col7 AS DOUBLE),
  CAST(col8 AS DOUBLE), CAST(col9 AS DOUBLE), CAST(col10 AS DOUBLE), col11 FROM (VALUES {_VALUES}))
, e AS (SELECT *, px + pvx * dt / 1000 AS fx, py + pvy * dt / 1000 AS fy, pz + pvz * dt / 1000 AS fz, (flags // 32) % 2 = 1 AND (pf // 32) % 2 = 0 AS rising FROM q)
, h AS (SELECT e.seq, m.id, m.kind, m.dest FROM e JOIN m ON e.pt IS NOT NULL AND CASE WHEN m.kind = 'teleport' THEN {_hull(_P, _AHEAD, 8)} AND {_FAR(_NOW, _T)} <= 96 AND (rising OR dist > 160)
  ELSE {_FAR(("pvx", "pvy", "pvz"), _T)} > 160 AND {_FAR(("vx", "vy", "vz"), _T)} <= 150 AND ({_hull(_P, _AHEAD, 2)} OR {_hull(_P, _NOW, 2)}) END)
, g AS (SELECT seq, COUNT(*) AS n, MIN(id) AS first_id, ARG_MIN(kind, id) AS first_kind, BOOL_AND(kind = 'teleport') AND COUNT(DISTINCT dest) = 1 AS same FROM h GROUP BY seq)
, c AS (SELECT e.*, CASE WHEN pt IS NULL THEN 'start' WHEN dt NOT BETWEEN 70 AND 130 THEN 'gap' WHEN NOT (ph > 0 AND health > 0) THEN 'life_boundary' WHEN g.n = 1 OR (g.n > 1 AND g.same) THEN first_kind
  WHEN g.n > 1 THEN 'ambiguous' WHEN dist > 160 OR rising THEN 'discontinuity' ELSE 'ordinary' END AS kind, first_id FROM e LEFT JOIN g USING (seq))"""


def _edges(spark, sf):
    schema = "id int, kind string, low array<double>, high array<double>, destination array<double>, velocity array<double>, destination_id int"
    d = frames(spark, sf).withColumn("held", hold()).withColumn("alive", alive())
    return geometry.classify_edges(d, ["rec"], "seq", spark.createDataFrame(_mechanism_rows(), schema))


@query(f"{EDGES} SELECT seq, kind, kind IN ('teleport', 'push', 'ordinary') AS known, CASE WHEN kind IN ('teleport', 'push') THEN CAST(first_id AS INTEGER) END AS id FROM c")
def classified_edges(spark, sf):
    """What each step of a track was."""
    return _edges(spark, sf).select("seq", "edge.kind", "edge.known", "edge.id")


@query(f"""{EDGES}, s AS (SELECT *, kind IN ('teleport', 'push', 'ordinary') AND ph > 0 AND health > 0 AS cont, COALESCE(ph > 0 AND health <= 0 AND dt BETWEEN 70 AND 130, FALSE) AS dies FROM c)
, i AS (SELECT *, SUM(CASE WHEN cont OR dies THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM s)
, l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY rec, island ORDER BY seq) AS rn FROM i WHERE health > 0 OR dies)
, pairs AS (SELECT a.seq AS anchor, a.rn AS arn, b.rn AS brn, b.seq AS bseq, b.dies AS bd, (b.dies OR b.time_ms - a.time_ms >= 1000) AS closing FROM l a JOIN l b ON a.rec = b.rec AND a.island = b.island AND b.rn > a.rn AND b.rn <= a.rn + 15 WHERE a.health > 0 AND a.time_ms % 200 = 0)
, ends AS (SELECT anchor, MIN(CASE WHEN closing THEN brn END) AS close_rn FROM pairs GROUP BY anchor)
SELECT anchor AS seq, CAST(LEAST(arn, 16) AS BIGINT) AS n_history, COUNT(*) AS n_future, MAX(bseq) AS last_seq, BOOL_OR(bd) AS terminal, ANY_VALUE(close_rn) IS NOT NULL AS complete
FROM pairs JOIN ends USING (anchor) WHERE close_rn IS NULL OR brn <= close_rn GROUP BY anchor, arn""")
def mechanism_windows(spark, sf):
    """Windows that teleports and pushes don't end."""
    d = geometry.mechanism_windows(_edges(spark, sf), ["rec"], "seq", "edge", ["seq", "time_ms", "health"])
    return d.select("seq", F.size("history").cast("long").alias("n_history"), F.size("future").cast("long").alias("n_future"), F.element_at("future", -1)["seq"].alias("last_seq"), "terminal", "complete")


def _rows(spark, sf):
    """Frames 100 ms after the one before them, as structs r and p with everything that the encoders take."""
    k, none = C("k"), F.lit(None).cast("double")
    some = lambda n, c: F.when(k % n != 0, c).cast("double")
    parts = {
        "yaw_rate": none, "grounded": ground(), "weapon": F.element_at(F.array(*map(F.lit, WEAPONS)), (k % len(WEAPONS) + 1).cast("int")), "ex": some(2, C("x") + 50), "ey": some(2, C("y") - 20), "ez": some(2, C("z")),
        "evx": some(2, C("vx")), "evy": some(2, C("vy")), "evz": some(2, C("vz")), "clear": k % 3 == 0, "complete": k % 4 != 0, "in_view": k % 5 == 0, "eye_known": F.lit(True), "rockets": k.cast("int"),
        "grenades": F.when(k % 6 != 0, k % 10).cast("int"), "ammo": F.when(k % 8 != 0, k * 20).cast("int"), "shot_age_ms": F.when(k % 9 != 0, k * 150).cast("int"), "gunframe": F.when(k % 7 != 0, k * 4).cast("int"),
        "held": hold(), "gravity": (k * 10).cast("int"),
    }
    d = frames(spark, sf).withColumn("r", F.struct("x", "y", "z", "vx", "vy", "vz", "yaw", "pitch", "health", "armor", *(c.alias(n) for n, c in parts.items())))
    d = d.withColumn("p", F.lag("r").over(track())).withColumn("dt", C("time_ms") - F.lag("time_ms").over(track()))
    return d.where("dt = 100")


def _points(n, step):
    """n landmark classes: a point step * i to the side, null where k + i is a multiple of three."""
    return [F.when((C("k") + i) % 3 != 0, F.struct((C("x") + step * i).alias("x"), (C("y") + 7).alias("y"), (C("z") - 9).alias("z"))) for i in range(n)]


def _shown(d, places):
    return d.select("seq", F.size("f").alias("width"), *(tidy(F.get("f", i)).alias(f"f{i}") for i in places))


def _point(i, step, known):
    x, y = _local(f"{step * i}", "7", "yaw", 1280)
    return f"CASE WHEN (k + {i}) % 3 <> 0 THEN {x} ELSE 0e0 END", f"CASE WHEN (k + {i}) % 3 <> 0 THEN {y} ELSE 0e0 END", f"CASE WHEN (k + {i}) % 3 <> 0 THEN {_tidy('-9 / 1280e0')} ELSE 0e0 END", f"CASE WHEN (k + {i}) % 3 <> 0 THEN 1e0 ELSE 0e0 END"


_STEP_SQL = f"""CAST(k % 3 = 0 AS INTEGER) + 0e0 AS f26, CAST(k % 4 <> 0 AS INTEGER) + 0e0 AS f27, CAST(k % 5 = 0 AS INTEGER) + 0e0 AS f28, 1e0 AS f29, {_tidy("LEAST(k, 20) / 20e0")} AS f30, CASE WHEN k % 6 <> 0 THEN {_tidy("(k % 10) / 20e0")} ELSE 0e0 END AS f31,
 {_point(0, 40, 0)[0]} AS f32, {_point(1, 40, 0)[1]} AS f37, {_point(2, 40, 0)[2]} AS f42, {_point(13, 40, 0)[3]} AS f87, CASE WHEN k % 8 <> 0 THEN {_tidy("LEAST(k * 20, 1000) / 200e0")} ELSE 0e0 END AS f88, CAST(k % 8 <> 0 AS INTEGER) + 0e0 AS f89,
 CASE WHEN k % 9 <> 0 THEN {_tidy("LEAST(k * 150, 10000) / 10000e0")} ELSE 0e0 END AS f90, CAST(k % 9 <> 0 AS INTEGER) + 0e0 AS f91, CASE WHEN k % 2 <> 0 THEN {_local("vx", "vy", "yaw", 320)[0]} ELSE 0e0 END AS f92, CAST(k % 2 <> 0 AS INTEGER) + 0e0 AS f95, 1e0 AS f96"""
_STEP_PLACES = (26, 27, 28, 29, 30, 31, 32, 37, 42, 87, 88, 89, 90, 91, 92, 95, 96)


@query(f"{LAG} SELECT seq, 97 AS width, {_STEP_SQL} FROM q WHERE dt = 100")
def sequence_features(spark, sf):
    """The 97 features of a step; those beyond the motion features are shown."""
    return _shown(_rows(spark, sf).withColumn("f", encode.sequence_step(C("p"), C("r"), WEAPONS, _points(14, 40.0))), _STEP_PLACES)


@query(f"""{LAG} SELECT seq, 351 AS width, 1e0 AS f96, {_tidy("k / 100e0")} AS f97, 0e0 AS f98, {_point(0, 25, 0)[0]} AS f165, {_point(22, 25, 0)[1]} AS f254, {_point(22, 25, 0)[3]} AS f256, {_point(5, -30, 0)[0]} AS f277, {_point(5, -30, 0)[3]} AS f280,
 CASE WHEN k % 7 <> 0 THEN {_tidy("LEAST(k * 4, 255) / 255e0")} ELSE 0e0 END AS f349, CAST(k % 7 <> 0 AS INTEGER) + 0e0 AS f350 FROM q WHERE dt = 100""")
def decision_features(spark, sf):
    """The 351 features of a decision; some of each part are shown."""
    memory = F.array(C("k") / F.lit(100.0), *[F.lit(0.0)] * (2 * (len(WEAPONS) + len(ITEMS)) - 1))
    f = encode.decision_step(C("p"), C("r"), WEAPONS, _points(14, 40.0), _points(23, 25.0), _points(23, -30.0), memory)
    return _shown(_rows(spark, sf).withColumn("f", f), (96, 97, 98, 165, 254, 256, 277, 280, 349, 350))


@query(f"""{LAG} SELECT seq, 26 AS width, {_local("vx", "vy", "yaw", 1000)[0]} AS f0, {_tidy("pitch / 180")} AS f3, {_tidy("SIN(RADIANS(yaw))")} AS f4, {_tidy("health / 200e0")} AS f6, CAST((flags // 32) % 2 AS INTEGER) + 0e0 AS f9, {_tidy("k * 10 / 800e0")} AS f10,
 CASE WHEN k % 3 <> 0 THEN {_local("15", "25", "yaw", 1280)[0]} ELSE 0e0 END AS f11, CASE WHEN k % 3 <> 0 THEN {_local("100", "-50", "yaw", 1280)[1]} ELSE 0e0 END AS f15, CAST(k % 3 <> 0 AS INTEGER) + 0e0 AS f17,
 CASE WHEN k % 5 <> 0 THEN {_tidy("(20 + 30) / 2 / 1280e0")} ELSE 0e0 END AS f20, CASE WHEN k % 5 <> 0 THEN {_local("300", "400", "yaw", 1000)[0]} ELSE 0e0 END AS f21, CAST(k % 5 <> 0 AS INTEGER) + 0e0 AS f24, 1e0 AS f25 FROM q WHERE dt = 100""")
def mechanism_features(spark, sf):
    """The 26 features of a row and its nearest mechanisms; some are shown."""
    box = lambda low, high, to: F.struct(*((C(a) + v).alias(f"{s}{a}") for s, vs in (("l", low), ("h", high)) for a, v in zip("xyz", vs)), *(v.alias(f"t{a}") for a, v in zip("xyz", to)))
    portal = F.when(C("k") % 3 != 0, box((10.0, 20.0, 0.0), (20.0, 30.0, 10.0), [C("x") + 100.0, C("y") - 50.0, C("z")]))
    pad = F.when(C("k") % 5 != 0, box((0.0, 0.0, 20.0), (10.0, 10.0, 30.0), [F.lit(300.0), F.lit(400.0), F.lit(500.0)]))
    return _shown(_rows(spark, sf).withColumn("f", encode.mechanism_step(C("r"), portal, pad)), (0, 3, 4, 6, 9, 10, 11, 15, 17, 20, 21, 24, 25))


@query("""SELECT seq, CASE WHEN k % 2 = 0 THEN 'enemy_absent' WHEN k % 3 = 0 THEN 'camera_unknown' WHEN k % 5 = 0 THEN 'world_occluded' WHEN k % 7 = 0 THEN 'horizontal_offscreen' WHEN k % 11 = 0 THEN 'mover_unknown' WHEN k % 13 = 0 THEN 'mvd_visibility_unknown'
 ELSE 'clear_center_candidate' END AS context FROM t""")
def visibility_contexts(spark, sf):
    """E5: why an enemy may not be seen: the first doubt."""
    no = lambda n: C("k") % n != 0
    enemy = F.when(C("k") % 4 != 0, no(2))  # unknown counts as absent
    return frames(spark, sf).select("seq", geometry.visibility(enemy, no(3), no(5), no(7), no(11), ~no(13)).alias("context"))


@query(f"{LAG} SELECT seq, k % 10 <> 0 AND NOT ({' OR '.join(_slab(_P, _NOW, [f'{200 * i}', '-50', '20'], [f'{200 * i + 40}', '100', '90']) for i in range(0, 12, 2))}) AS complete FROM q WHERE dt = 100")
def mover_completeness(spark, sf):
    """Whether a step's ray misses every mover whose place isn't known; one without an envelope leaves it open."""
    arr = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    all_ = [F.struct(arr(200 * i, -50, 20).alias("low"), arr(200 * i + 40, 100, 90).alias("high"), F.lit(i % 2 == 1).alias("transparent")) for i in range(12)]
    nowhere = F.struct(F.lit(None).cast("array<double>").alias("low"), F.lit(None).cast("array<double>").alias("high"), F.lit(False).alias("transparent"))
    d = frames(spark, sf).withColumns({f"p{a}": F.lag(a).over(track()) for a in "xyz"} | {"dt": C("time_ms") - F.lag("time_ms").over(track())}).where("dt = 100")
    movers = F.when(C("k") % 10 == 0, F.array(*all_, nowhere)).otherwise(F.array(*all_))
    return d.select("seq", geometry.collision_complete([C(c) for c in _P], [C(c) for c in _NOW], movers).alias("complete"))


@query("""WITH p AS (SELECT a.s_suppkey AS node, b.s_suppkey AS other, ABS(a.s_acctbal - b.s_acctbal) AS d FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey)
SELECT node, other, d FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY node ORDER BY d, other) AS rn FROM p) r WHERE rn BETWEEN 2 AND 3""", start="")
def control_candidates(spark, sf):
    """Of the others near a node, the second and third nearest."""
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    a, b = s.select("s_nationkey", C("s_suppkey").alias("node"), C("s_acctbal").alias("u")), s.select("s_nationkey", C("s_suppkey").alias("other"), C("s_acctbal").alias("v"))
    pairs = a.join(b, "s_nationkey").where("node <> other").select("node", "other", F.abs(C("u") - C("v")).alias("d"))
    return geometry.neighbours(pairs, "node", "other", "d", 1, 2)


TREE = [
    {"feature": 0, "threshold": 100.1, "left": 1, "right": 2, "value": 0}, {"feature": 2, "threshold": 60.0, "left": 3, "right": 4, "value": 0}, {"feature": 1, "threshold": 0.3, "left": 5, "right": 6, "value": 0},
    {"feature": -1, "threshold": 0, "left": -1, "right": -1, "value": 1.5}, {"feature": -1, "threshold": 0, "left": -1, "right": -1, "value": -2.0},
    {"feature": -1, "threshold": 0, "left": -1, "right": -1, "value": 0.25}, {"feature": -1, "threshold": 0, "left": -1, "right": -1, "value": 7.0},
]


@query("""SELECT seq, CASE WHEN CAST(x AS FLOAT) <= CAST(100.1 AS FLOAT) THEN CASE WHEN CAST(z AS FLOAT) <= 60 THEN 1.5e0 ELSE -2e0 END ELSE CASE WHEN CAST(y / 10 AS FLOAT) <= CAST(0.3 AS FLOAT) THEN 0.25e0 ELSE 7e0 END END AS score FROM t""")
def tree_scores(spark, sf):
    """A decision tree's value, compared in single precision."""
    assert datasets.tree_violations(TREE, 3) == []
    d = frames(spark, sf).withColumn("x_", F.array("x", C("y") / 10, "z"))
    return d.select("seq", datasets.tree_column(TREE, "x_").alias("score"))


@query("SELECT n_name AS tensor, n_nationkey + n_regionkey * 0.5e0 AS v0, 1e0 - n_nationkey AS v1 FROM nation", start="")
def weight_overlays(spark, sf):
    """A base and a delta, tensor by tensor."""
    n = spark.read.parquet(f"{sf}/nation.parquet")
    base = n.select(C("n_name").alias("tensor"), F.array(C("n_nationkey").cast("double"), F.lit(1.0)).alias("v"))
    delta = n.select(C("n_name").alias("tensor"), F.array(C("n_regionkey") * 0.5, -C("n_nationkey").cast("double")).alias("v"))
    return datasets.overlay(base, delta, "tensor", "v").select("tensor", F.get("v", 0).alias("v0"), F.get("v", 1).alias("v1"))


# Classes of entities on a map, for the placements.
_CLASSES = ("weapon_railgun", "ammo_cells", "ammo_slugs", "item_health", "item_health_small", "item_health_large", "item_health_mega", "item_armor_body", "info_player_start", "func_door")
_CLASS_SQL = "(CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CLASSES)) + " END)"


@query(f"""WITH e AS (SELECT p_partkey AS id, 'm' || (p_size % 3) AS map, {_CLASS_SQL} AS c, p_partkey % 7 AS s FROM part)
SELECT map, id, CASE WHEN c IN ('item_health_small', 'item_health_large') THEN 'item_health' ELSE c END AS class, CASE WHEN c LIKE 'ammo%' THEN 'ammo' ELSE c END AS landmark FROM e WHERE s <> 0 AND c NOT IN ('info_player_start', 'func_door')""", start="")
def item_placements(spark, sf):
    """Placements of items and landmarks that duels have."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    klass = F.element_at(F.array(*map(F.lit, _CLASSES)), (C("p_partkey") % 10 + 1).cast("int"))
    e = p.select(F.concat(F.lit("m"), (C("p_size") % 3).cast("string")).alias("map"), C("p_partkey").alias("id"), klass.alias("classname"), F.when(C("p_partkey") % 7 == 0, 2049).otherwise(1).alias("spawnflags"), F.array(F.lit(0.0)).alias("origin"))
    return maps.placements(e).select("map", "id", "class", "landmark")


@query("SELECT seq, CASE WHEN k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0 THEN NULL ELSE x END AS vx, CASE WHEN k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0 THEN NULL ELSE -z END AS vz FROM t")
def parsed_vectors(spark, sf):
    """C4: texts of three finite numbers below 65536."""
    k, s = C("k"), lambda c: c.cast("string")
    text = F.when(k % 7 == 0, F.concat_ws(" ", s(C("x")), s(C("y")))).when(k % 11 == 0, F.lit("1 two 3")).when(k % 13 == 0, F.lit("0 65536 0")).when(k % 17 == 0, F.lit("0 NaN 1"))
    text = text.otherwise(F.concat(F.lit(" "), F.concat_ws("  ", s(C("x")), s(C("y")), s(-C("z"))), F.lit("\t")))
    d = frames(spark, sf).withColumn("v", S.vector(text))
    return d.select("seq", (F.get("v", 0) + 0.0).alias("vx"), (F.get("v", 2) + 0.0).alias("vz"))


@query(f""", s AS (SELECT AVG(x) AS mx, GREATEST(STDDEV_POP(x), 0.05) AS sx, AVG(y) AS my, GREATEST(STDDEV_POP(y), 0.05) AS sy FROM t WHERE rec % 3 <> 0)
SELECT seq, {_tidy("GREATEST(LEAST((x - mx) / sx, 10), -10)")} AS x0, {_tidy("GREATEST(LEAST((y * 1000 - my) / sy, 10), -10)")} AS x1 FROM t, s""")
def scaled_rows(spark, sf):
    """Values scaled by the training rows' mean and deviation, and clipped."""
    d = frames(spark, sf)
    s = d.where("rec % 3 <> 0").agg(F.array(F.avg("x"), F.avg("y")).alias("m"), F.array(F.stddev_pop("x"), F.stddev_pop("y")).alias("s"))
    d = d.join(F.broadcast(s)).withColumn("v", encode.standardise(F.array("x", C("y") * 1000), C("m"), C("s")))  # one row
    return d.select("seq", tidy(F.get("v", 0)).alias("x0"), tidy(F.get("v", 1)).alias("x1"))


@query("""SELECT CAST(n_regionkey AS BIGINT) AS region, CASE WHEN n_regionkey % 2 = 0 THEN 'stock' ELSE 'ffa_mod' END AS adapter, CASE WHEN n_regionkey % 2 = 1 THEN substr(n_name, 1, 15) END AS name, CASE WHEN n_regionkey % 2 = 0 THEN CAST(n_nationkey AS INTEGER) END AS slot,
 CAST(n_nationkey * 3 - 5 AS INTEGER) AS score, CASE WHEN n_regionkey % 2 = 1 THEN CAST(n_nationkey AS INTEGER) END AS deaths FROM nation""", start="")
def scoreboard_rows(spark, sf):
    """Tables drawn in the layout language, read back."""
    n = spark.read.parquet(f"{sf}/nation.parquet").withColumn("rank", F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")))
    key, s = C("n_nationkey"), lambda c: c.cast("string")
    client = F.concat(F.lit("xv 0 yv 8 client 0 8 "), s(key), F.lit(" "), s(key * 3 - 5), F.lit(" 30 4"))
    line = F.concat(F.lit('xv 0 yv '), s(C("rank") * 8), F.lit(' string "'), F.lpad(s(C("rank")), 3, " "), F.rpad("n_name", 15, " "), F.lit(" "), s(key * 3 - 5), F.lit(" "), s(key), F.lit('"'))
    rows = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("rank", F.when(C("n_regionkey") % 2 == 0, client).otherwise(line).alias("l")))).alias("ls"))
    head = F.when(C("n_regionkey") % 2 == 1, 'yv 0 string2 "Player          Frg Dth" ').otherwise("")
    d = rows.select(C("n_regionkey").cast("long").alias("region"), F.explode(scoreboard(F.concat(head, F.array_join(F.transform("ls", lambda x: x["l"]), " ")))).alias("r"))
    return d.select("region", "r.adapter", "r.name", "r.slot", "r.score", "r.deaths")


@query(""", told AS (SELECT rec, label, seq, k % 5 AS number, FALSE AS gone, k AS v FROM t UNION ALL SELECT rec, label, seq, (k + 1) % 5, TRUE, NULL FROM t WHERE event_type = 'error')
, grid AS (SELECT n.rec, n.label, n.number, t.seq, t.time_ms FROM (SELECT DISTINCT rec, label, number FROM told) n JOIN t ON n.rec = t.rec AND n.label = t.label)
, c AS (SELECT g.*, LAST_VALUE(d.gone IGNORE NULLS) OVER w AS gone, MAX(CASE WHEN d.gone IS NOT NULL THEN d.seq END) OVER w AS told_seq FROM grid g LEFT JOIN told d USING (rec, label, number, seq) WINDOW w AS (PARTITION BY g.rec, g.label, g.number ORDER BY g.seq ROWS UNBOUNDED PRECEDING))
SELECT c.rec, CAST(c.label AS BIGINT) AS segment, CAST(c.number AS BIGINT) AS number, c.seq, NOT c.gone AS present, CAST(d.v AS BIGINT) AS v FROM c LEFT JOIN told d ON c.rec = d.rec AND c.label = d.label AND c.number = d.number AND c.told_seq = d.seq AND NOT d.gone WHERE c.gone IS NOT NULL""")
def carried_states(spark, sf):
    """Entities between the frames that mention them; a removed one is absent."""
    one = F.array(F.struct((C("k") % 5).alias("number"), C("k").alias("v")))
    gone = F.when(C("event_type") == "error", F.array((C("k") + 1) % 5)).otherwise(F.array().cast("array<bigint>"))
    d = frames(spark, sf).select(C("rec").alias("recording_id"), C("label").alias("segment"), "seq", "time_ms", one.alias("entities"), gone.alias("removed"))
    d = records.carried_entities(d)
    return d.select(C("recording_id").alias("rec"), C("segment").cast("long"), C("number").cast("long"), "seq", "present", C("entity.v").cast("long").alias("v"))


@query("SELECT seq, ROW_NUMBER() OVER (PARTITION BY rec, label, k % 2 ORDER BY seq) - 1 AS shot FROM t WHERE event_type = 'click'")
def shot_tracks(spark, sf):
    """Shots by recording, epoch and slot."""
    d = frames(spark, sf).where("event_type = 'click'").withColumn("slot", C("k") % 2)
    return rulings.shot_tracks(d, ["rec", "slot"], "label", "seq").select("seq", C("shot").cast("long"))


@query("""SELECT seq, CASE WHEN k % 23 = 0 THEN 'open' WHEN k % 19 = 0 THEN 'unsupported' WHEN k % 17 = 0 THEN 'truncated' WHEN k % 13 = 0 THEN 'format' WHEN k % 29 = 0 THEN 'unsupported' WHEN k % 11 = 0 THEN 'provenance_too_long' WHEN k % 7 = 0 THEN 'map_mismatch'
 WHEN label > 1 AND k % 3 = 0 THEN 'ambiguous' WHEN armor = 0 THEN 'no_pov' WHEN z = 0 THEN 'empty' ELSE 'ok' END AS verdict FROM t""")
def ingest_verdicts(spark, sf):
    """Why a recording isn't taken."""
    on = lambda n: C("k") % n == 0
    code = F.when(on(23), "open").when(on(19) | on(13), "format").when(on(17), "truncated").when(on(29), "memory").otherwise("ok")
    return frames(spark, sf).select("seq", rulings.ingest_verdict(code, on(19), on(17), on(11), on(7), C("label"), ~on(3), C("armor"), C("z")).alias("verdict"))


@query(""", n AS (SELECT rec, seq, CASE WHEN rec % 4 = 0 THEN 'Q2DM' || (k % 2) WHEN k % 2 = 0 THEN 'q2dm' || (rec % 5) ELSE 'Q2DM' || (rec % 5) END AS name FROM t WHERE k % 3 = 0)
SELECT rec, ARG_MIN(name, seq) AS map, COUNT(DISTINCT LOWER(name)) > 1 OR BOOL_OR(LOWER(name) <> 'q2dm' || (rec % 6)) AS mismatch FROM n GROUP BY rec""")
def recording_maps(spark, sf):
    """The map of a recording, and whether it names two or another one than expected."""
    s = lambda c: c.cast("string")
    name = F.when(C("rec") % 4 == 0, F.concat(F.lit("Q2DM"), s(C("k") % 2))).when(C("k") % 2 == 0, F.concat(F.lit("q2dm"), s(C("rec") % 5))).otherwise(F.concat(F.lit("Q2DM"), s(C("rec") % 5)))
    d = frames(spark, sf).withColumn("name", F.when(C("k") % 3 == 0, name))
    return rulings.recording_maps(d, "rec", "seq", "name", F.concat(F.lit("Q2dm"), s(C("rec") % 6)))


@query(""", d AS (SELECT rec, k % 6 AS name, seq, x, y FROM t WHERE event_type = 'view' AND k % 6 <> 5), f AS (SELECT rec, name, MIN(seq) AS seq FROM d GROUP BY rec, name)
SELECT s.seq, d.x AS dx, d.y AS dy FROM (SELECT * FROM t WHERE event_type = 'purchase') s LEFT JOIN f ON f.rec = s.rec AND f.name = s.label LEFT JOIN d ON d.seq = f.seq""")
def first_destinations(spark, sf):
    """A portal leads to the first entity of its target's name."""
    d = frames(spark, sf)
    name = F.concat(F.lit("t"), (C("k") % 6).cast("string"))
    goals = d.where("event_type = 'view'").select("rec", "seq", F.when(C("k") % 6 != 5, name).otherwise("").alias("targetname"), C("x").alias("dx"), C("y").alias("dy"))
    portals = d.where("event_type = 'purchase'").select("rec", "seq", F.concat(F.lit("t"), C("label").cast("string")).alias("target"))
    return rulings.first_named(portals, goals, "target", "targetname", "seq", ["dx", "dy"], on=["rec"]).select("seq", "dx", "dy")


@query("""SELECT rec, CASE k % 13 WHEN 0 THEN 'blaster' WHEN 1 THEN 'railgun' ELSE 'bfg10k' END AS weapon, COUNT(*) AS n FROM t WHERE event_type = 'error' AND k % 13 < 3 GROUP BY 1, 2""")
def weapon_counts(spark, sf):
    """Deaths by weapon, unknown ones nowhere."""
    w = F.when(C("k") % 13 == 0, "blaster").when(C("k") % 13 == 1, "railgun").when(C("k") % 13 == 2, "bfg10k").when(C("k") % 13 == 3, "lava").when(C("k") % 13 == 4, "unknown")
    return rulings.weapon_counts(frames(spark, sf).where("event_type = 'error'").withColumn("weapon", w), ["rec"], "weapon")


@query(""", s AS (SELECT *, SUM(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY seq ROWS UNBOUNDED PRECEDING) AS segment FROM t)
SELECT seq, CAST(segment AS BIGINT) AS segment, LAST_VALUE(CASE WHEN event_type = 'purchase' THEN label END IGNORE NULLS) OVER (PARTITION BY rec, segment, k % 2 ORDER BY seq ROWS UNBOUNDED PRECEDING) AS state FROM s""")
def segment_states(spark, sf):
    """What a slot was last told, in this segment only."""
    d = frames(spark, sf).withColumn("slot", C("k") % 2)
    d = rulings.within_segment(d, "rec", "seq", C("event_type") == "signup", ["slot"], F.when(C("event_type") == "purchase", C("label")), "state")
    return d.select("seq", "segment", "state")


@query(""", g AS (SELECT rec, label, CASE WHEN k % 9 <> 0 THEN (k % 20) || '-' || label END AS pair, CASE WHEN rec % 5 = 0 THEN 'test' WHEN rec % 5 = 1 THEN 'validation' ELSE 'train' END AS split FROM t)
SELECT split, COUNT(*) AS matches, COUNT(DISTINCT pair) AS pairs, (SELECT COUNT(DISTINCT pair) FROM g) AS unique_pairs FROM g GROUP BY split""")
def pair_report(spark, sf):
    """Matches and pairs by split."""
    split = F.when(C("rec") % 5 == 0, "test").when(C("rec") % 5 == 1, "validation").otherwise("train")
    pair = F.when(C("k") % 9 != 0, F.concat((C("k") % 20).cast("string"), F.lit("-"), C("label").cast("string")))
    return rulings.pair_report(frames(spark, sf).select(pair.alias("pair"), split.alias("split")), "pair", "split")


@query("""SELECT seq, k % 11 <> 0 AS accepted FROM (SELECT *, COALESCE(SUM(CASE WHEN k % 11 <> 0 THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM t) u WHERE r = 0""")
def continual_runs(spark, sf):
    """Runs until one is rejected."""
    return rulings.continual_runs(frames(spark, sf), ["rec"], "seq", C("k") % 11 != 0).select("seq", "accepted")


@query(""", h AS (SELECT rec, BOOL_OR(label = 0) AS a, BOOL_OR(label = 1) AS b, BOOL_OR(label = 2) AS c FROM t WHERE k % 7 = 0 GROUP BY rec)
SELECT rec, array_to_string(list_filter([CASE WHEN NOT c THEN 'test' END, CASE WHEN NOT a THEN 'train' END, CASE WHEN NOT b THEN 'validation' END], lambda x: x IS NOT NULL), ',') AS missing FROM h WHERE NOT (a AND b AND c)""")
def missing_splits(spark, sf):
    """Maps without rows of a split."""
    split = F.when(C("label") == 0, "train").when(C("label") == 1, "validation").when(C("label") == 2, "test").otherwise("other")
    return rulings.missing_splits(frames(spark, sf).where("k % 7 = 0").withColumn("split", split), "rec", "split")


@query("""WITH a AS (SELECT n_name AS k, n_regionkey AS v FROM nation WHERE n_nationkey % 5 <> 0), b AS (SELECT n_name AS k, CASE WHEN n_nationkey % 4 = 0 THEN n_regionkey + 1 ELSE n_regionkey END AS v FROM nation WHERE n_nationkey % 7 <> 0)
SELECT COALESCE(a.k, b.k) AS key, CAST(a.v AS BIGINT) AS was, CAST(b.v AS BIGINT) AS "is" FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""", start="")
def changed_pins(spark, sf):
    """Where a stored contract and the present one differ."""
    n = spark.read.parquet(f"{sf}/nation.parquet").withColumn("v", C("n_regionkey").cast("long"))
    now = n.where("n_nationkey % 7 <> 0").select(C("n_name").alias("key"), F.when(C("n_nationkey") % 4 == 0, C("v") + 1).otherwise(C("v")).alias("v"))
    return rulings.changed_pins(n.where("n_nationkey % 5 <> 0").select(C("n_name").alias("key"), "v"), now, "key", "v")


@query(""", r AS (SELECT *, CASE WHEN k % 10 < 6 THEN 0 WHEN k % 10 < 9 THEN 1 ELSE 2 END AS cls, k % 4 - 1 AS cur FROM t)
, n AS (SELECT cls, COUNT(*) AS n FROM r WHERE rec % 3 = 0 GROUP BY cls), w AS (SELECT cls, GREATEST(LEAST(SQRT((SELECT AVG(n) FROM n) / n), 4.0), 0.25) AS w FROM n)
, f AS (SELECT GREATEST(LEAST(SUM(CASE WHEN cur >= 0 THEN 1 ELSE 0 END) / GREATEST(SUM(CASE WHEN cur >= 0 AND cls <> cur THEN 1 ELSE 0 END), 1), 8.0), 1.0) AS f FROM r WHERE rec % 3 = 0)
, z AS (SELECT seq, z.i, z.v - LN((SELECT w FROM w WHERE w.cls = z.i)) - CASE WHEN cur >= 0 AND cur <> z.i THEN LN((SELECT f FROM f)) ELSE 0 END AS v FROM r, (VALUES (0), (1), (2)) AS c(j), LATERAL (SELECT c.j AS i, CASE c.j WHEN 0 THEN vx / 300 WHEN 1 THEN vy / 100 ELSE vz / 150 END AS v) z WHERE rec % 3 <> 0)
SELECT seq, CAST(ARG_MIN(i, (-ROUND(v, 9), i)) AS INTEGER) AS choice FROM z GROUP BY seq""")
def corrected_choices(spark, sf):
    """Choices of one table, corrected by the weights of another."""
    k = C("k") % 10
    d = frames(spark, sf).withColumn("y_", F.when(k < 6, 0).when(k < 9, 1).otherwise(2)).withColumn("cur", (C("k") % 4 - 1).cast("int"))
    d = d.withColumn("z_", F.array(C("vx") / 300, C("vy") / 100, C("vz") / 150))
    return rulings.corrected_choice(d.where("rec % 3 <> 0"), d.where("rec % 3 = 0"), "z_", "y_", "cur").select("seq", "choice")


def _recording(pdf: pd.DataFrame) -> pd.DataFrame:
    """One recording of a user's frames: each told by its change from the one before, or the sixth before, or whole."""
    rows = pdf.sort_values("seq")
    told = []
    for n, (seq, x, z, vx, health, armor, k) in enumerate(zip(*(rows[c].tolist() for c in ("seq", "x", "z", "vx", "health", "armor", "k"))), 1):
        stats = [0, int(health), 0, 0, 0, int(armor)] + [0] * 26
        player = {"ox": x % 4000, "oz": z, "vx": vx, "stats": stats, "gunframe": int(k) % 50}
        world = {int(e): {"ox": float(k), "frame": int(k) % 300, "model1": 1 + int(k) % 7} for e in range(1, 6) if (k + e) % 4}
        told.append((n, -1 if n % 9 == 1 or n < 7 else n - 1 if n % 2 else n - 6, player, world))
    return pd.DataFrame({"content_sha": [str(rows["rec"].iloc[0])], "content": [recorded.encode(told, "q2dm1")]})


def _recordings(spark, sf):
    d = frames(spark, sf).select("rec", "seq", "x", "z", "vx", "health", "armor", "k")
    return d.groupBy("rec").applyInPandas(_recording, "content_sha string, content binary")


_NUMBERED = ", n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY rec ORDER BY seq) AS frame FROM t)"


@query(f"""{_NUMBERED} SELECT CAST(rec AS VARCHAR) AS recording_id, (frame - 1) * 100 AS time_ms, x % 4000 AS x, z, vx, CAST(health AS BIGINT) AS health, CAST(armor AS BIGINT) AS armor, CAST(k % 50 AS BIGINT) AS gunframe FROM n""")
def decoded_states(spark, sf):
    """Player states of recordings, through their wire format and back."""
    d = records.demultiplex(recorded.decoded(_recordings(spark, sf)))["player_states"]
    v = lambda c, i: F.get(c, i).cast("double")
    stat = lambda i: F.get("stats", i).cast("long")
    return d.select("recording_id", "time_ms", v("origin", 0).alias("x"), v("origin", 2).alias("z"), v("velocity", 0).alias("vx"), stat(1).alias("health"), stat(5).alias("armor"), C("gunframe").cast("long"))


@query(f"""{_NUMBERED} SELECT CAST(rec AS VARCHAR) AS recording_id, CAST(frame AS BIGINT) AS frame, e AS number, CAST(k AS DOUBLE) AS x, CAST(k % 300 AS BIGINT) AS pose, CAST(1 + k % 7 AS BIGINT) AS model FROM n, (SELECT CAST(range AS BIGINT) AS e FROM range(1, 6)) r WHERE (k + e) % 4 <> 0""")
def decoded_entities(spark, sf):
    """Entities of every frame, told by changes from earlier ones."""
    d = records.demultiplex(recorded.decoded(_recordings(spark, sf)))["entity_frames"].select("recording_id", C("frame_number").cast("long").alias("frame"), F.explode("entities").alias("e"))
    return d.select("recording_id", "frame", C("e.number").cast("long").alias("number"), F.get("e.origin", 0).cast("double").alias("x"), C("e.frame").cast("long").alias("pose"), F.get("e.models", 0).cast("long").alias("model"))


@query("SELECT CAST(rec AS VARCHAR) AS recording_id, 34 AS protocol, CASE WHEN rec % 3 = 0 THEN 'truncated' WHEN rec % 3 = 1 THEN 'unsupported command 31' END AS reason, CASE WHEN rec % 3 = 0 THEN -3 WHEN rec % 3 = 1 THEN -2 ELSE 0 END AS code FROM (SELECT DISTINCT rec FROM t) r")
def decode_results(spark, sf):
    """Recordings that are cut off, that lose the stream, and whole ones."""
    d = _recordings(spark, sf)
    whole = F.expr("substring(content, 1, length(content) - 4)")  # without the mark of the end
    rest = F.col("content_sha").cast("int") % 3
    lost = F.concat(whole, F.unhex(F.lit("010000001F")))
    d = d.withColumn("content", F.when(rest == 0, F.expr("substring(content, 1, length(content) - 6)")).when(rest == 1, lost).otherwise(C("content")))
    r = recorded.decoded(d).where("kind IN ('decode_result', 'segment')")
    both = r.select("recording_id", F.from_json("payload", "protocol int, reason string, return_code int").alias("p"))
    return both.groupBy("recording_id").agg(F.max("p.protocol").alias("protocol"), F.max("p.reason").alias("reason"), F.max("p.return_code").alias("code"))


@query(f"{_NUMBERED} SELECT CAST(rec AS VARCHAR) AS recording_id, 34 AS protocol, 'q2dm1' AS map, CAST(COUNT(*) + 2 AS BIGINT) AS packets, FALSE AS complete FROM n GROUP BY rec")
def scanned_headers(spark, sf):
    """What the cheap scan of a recording's start tells; it stops at the first frame."""
    d = demos.headers(_recordings(spark, sf))
    return d.select(C("content_sha").alias("recording_id"), "protocol", F.get("maps", 0).alias("map"), C("packets").cast("long"), "complete")


def _archive(pdf: pd.DataFrame) -> pd.DataFrame:
    """A zip of each of a user's first recordings: plain members, a member that is no recording, an archive inside."""
    import io
    import zipfile

    def pack(members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members:
                z.writestr(name, data)
        return out.getvalue()

    rec, keys = pdf["rec"].iloc[0], sorted(pdf["seq"].tolist())[:3]
    deep = pack([(f"deep{k}.DM2", f"deep {k}") for k in keys[:1]])
    return pd.DataFrame({"path": [f"/in/{rec}.zip"], "content": [pack([*((f"a/{k}.dm2", f"frame {k}") for k in keys), ("readme.txt", "no"), ("more.zip", deep)])]})


@query(f"""{_NUMBERED}, m AS (SELECT rec, seq || '.dm2' AS member, 'frame ' || seq AS body FROM n WHERE frame <= 3 UNION ALL SELECT rec, 'deep' || seq || '.DM2', 'deep ' || seq FROM n WHERE frame = 1)
SELECT '/in/' || rec || '.zip' AS path, member, CAST(strlen(body) AS BIGINT) AS bytes, sha256(body) AS content_sha FROM m""")
def archived_recordings(spark, sf):
    """Recordings in archives and in archives inside them."""
    d = frames(spark, sf).select("rec", "seq").groupBy("rec").applyInPandas(_archive, "path string, content binary")
    found = files.expanded(d).where("error IS NULL")
    return found.select("path", F.element_at(F.split("name", "/"), -1).alias("member"), C("bytes").cast("long"), "content_sha")


def _map_file(pdf: pd.DataFrame) -> pd.DataFrame:
    """A map of each region: its nations are teleports, destinations and items."""
    region, found = pdf["n_regionkey"].iloc[0], [{"classname": "worldspawn", "message": "made"}]
    for n in sorted(pdf["n_nationkey"].tolist()):
        found.append({"classname": "trigger_teleport", "model": "*1", "target": f"t{n % 4}", "origin": f"{n} 0 0"})
        found.append({"classname": "misc_teleporter_dest", "targetname": f"t{n % 6}", "origin": f"{10 * n} 5 -3", **({"spawnflags": "2048"} if n % 5 == 0 else {})})
        found.append({"classname": "item_health_large", "origin": f"1 {n} 2"})
    raw = maps.written(found, [[0, 0, 0, 1, 1, 1], [-8, -8, 0, 8, 8, 16]], [[0, 0, 0], [64, 32, 16]])
    return pd.DataFrame({"path": [f"/maps/r{region}.bsp"], "content": [raw if region % 4 != 3 else raw[:-5]]})


def _maps(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select("n_regionkey", "n_nationkey")
    return maps.inspected(n.groupBy("n_regionkey").applyInPandas(_map_file, "path string, content binary"))


_MADE = """WITH n AS (SELECT *, n_nationkey AS k, 'r' || n_regionkey AS map, ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation WHERE n_regionkey % 4 <> 3)
, e AS (SELECT map, CAST(3 * rn - 2 AS INTEGER) AS id, 'trigger_teleport' AS classname, k + 0e0 AS x, 0 AS spawnflags, 't' || (k % 4) AS name, k FROM n
  UNION ALL SELECT map, CAST(3 * rn - 1 AS INTEGER), 'misc_teleporter_dest', k * 10e0, CASE WHEN k % 5 = 0 THEN 2048 ELSE 0 END, 't' || (k % 6), k FROM n UNION ALL SELECT map, CAST(3 * rn AS INTEGER), 'item_health_large', 1e0, 0, NULL, k FROM n)"""


@query(f"{_MADE} SELECT map, id, classname, x, spawnflags FROM e UNION ALL SELECT DISTINCT map, 0, 'worldspawn', 0e0, 0 FROM n", start="")
def map_entities(spark, sf):
    """Entities of map files; a broken file has an error and no entities."""
    return maps.entity_rows(_maps(spark, sf)).select("map", C("id").cast("int"), "classname", (F.get("origin", 0) + 0.0).alias("x"), "spawnflags")


@query(f"""{_MADE}, d AS (SELECT map, name, COUNT(*) AS c, ANY_VALUE(x) AS dx FROM e WHERE classname = 'misc_teleporter_dest' AND spawnflags = 0 GROUP BY map, name)
SELECT e.map, e.id, e.x - 8 AS low, e.x + 8 AS high, CASE WHEN d.c = 1 THEN d.dx END AS to_x, CASE WHEN d.c = 1 THEN 7e0 END AS to_z, CASE WHEN d.c IS NULL THEN 'missing_target' WHEN d.c > 1 THEN 'ambiguous_target' END AS reason, COALESCE(d.c = 1, FALSE) AS resolved
FROM e LEFT JOIN d ON e.map = d.map AND e.name = d.name WHERE e.classname = 'trigger_teleport'""", start="")
def map_mechanisms(spark, sf):
    """Teleports of maps with their one destination."""
    d = maps.mechanisms(_maps(spark, sf))
    return d.select("map", C("id").cast("int"), (F.get("low", 0) + 0.0).alias("low"), (F.get("high", 0) + 0.0).alias("high"), (F.get("destination", 0) + 0.0).alias("to_x"), (F.get("destination", 2) + 0.0).alias("to_z"), C("unresolved_reason").alias("reason"), "resolved")


@query(""", d AS (SELECT * FROM t UNION ALL SELECT * FROM t WHERE k % 29 = 0)
SELECT seq, rule FROM d, (VALUES (7, 'x_shape'), (11, 'x_finite'), (13, 'y_shape'), (17, 'masks'), (19, 'events_within_masks'), (23, 'split')) r(m, rule) WHERE k % m = 0 UNION ALL SELECT seq, 'repeated' FROM t WHERE k % 29 = 0""")
def dataset_rules(spark, sf):
    """Samples of a dataset that break its rules."""
    on = lambda n: C("k") % n == 0
    step = F.array(C("y") / 100, F.when(on(11), 1e9).otherwise(0.5))
    d = frames(spark, sf)
    d = d.unionByName(d.where(on(29)))
    d = d.select(
        "seq", F.when(on(7), F.array(step)).otherwise(F.array(step, step)).alias("x"), F.when(on(13), F.array(F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("y"),
        F.array(F.when(on(17), 2).otherwise(1), F.lit(0)).alias("y_mask"), F.array(F.when(on(19), 1).otherwise(0)).alias("events"), F.array(F.lit(0)).alias("event_mask"), F.when(on(23), "all").otherwise("train").alias("split"),
    )
    return datasets.dataset_violations(d, "seq", 2, 2, 2)


_GRID = [(a, b) for a in (-1, 0, 1) for b in range(5)]


@query(f"""SELECT seq, CAST(ARG_MIN(a, (s, a, b)) AS INTEGER) AS a, CAST(ARG_MIN(b, (s, a, b)) AS INTEGER) AS b, MIN(s) AS score FROM (SELECT seq, a, b, ABS(vx - a * 100) + ABS(z - b * 25) AS s FROM t, (VALUES {", ".join(map(str, _GRID))}) g(a, b)) c GROUP BY seq""")
def best_candidates(spark, sf):
    """The candidate of a fixed grid that explains a row best."""
    grid = spark.createDataFrame(_GRID, "a int, b int")
    d = geometry.best_candidate(frames(spark, sf), grid, lambda c: F.abs(C("vx") - c["a"] * 100) + F.abs(C("z") - c["b"] * 25))
    return d.select("seq", "best.candidate.a", "best.candidate.b", "best.score")


_BRUSHES = [(150.3 * i + 0.1, -10.3, 10.7, 150.3 * i + 60.2, 20.9, 70.3) for i in range(12)]


@query(f"{LAG} SELECT seq, NOT ({' OR '.join(_slab(_P, _NOW, b[:3], b[3:]) for b in _BRUSHES)}) AS clear FROM q WHERE dt = 100")
def clear_rays(spark, sf):
    """Steps whose ray meets no brush."""
    plane = lambda n, d: F.struct(*(F.lit(float(v)).alias(f"n{a}") for a, v in zip("xyz", n)), F.lit(float(d)).alias("d"))
    sides = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    box = lambda b: F.array(*(plane([-v for v in n], -b[i]) for i, n in enumerate(sides)), *(plane(n, b[3 + i]) for i, n in enumerate(sides)))
    d = frames(spark, sf).withColumns({f"p{a}": F.lag(a).over(track()) for a in "xyz"} | {"dt": C("time_ms") - F.lag("time_ms").over(track())}).where("dt = 100")
    return d.select("seq", geometry.ray_clear([C(c) for c in _P], [C(c) for c in _NOW], F.array(*map(box, _BRUSHES))).alias("clear"))
