"""Queries of the trajectory operators over the frames of track.py, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof, encode, filters, geometry, intervals, islands, labels, phases
from ..operators import aggregates as A
from .track import CTE, GROUNDED, HELD, frames

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

C = F.col


def alive():
    return C("health") > 0


def ground():
    return C("flags").bitwiseAND(F.lit(4)) != 0


def hold():
    return C("flags").bitwiseAND(F.lit(32)) != 0


def track():
    return islands.ordered(["rec"], ["seq"])


def query(sql: str | None = None):
    """Registers a query of this module's name for it; sql follows the frames' expression t."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"{CTE} {sql}"
        return f

    return add


def _step(c):
    return C(c) - F.lag(c).over(track())


def _distance():
    return F.sqrt(_step("x") * _step("x") + _step("y") * _step("y") + _step("z") * _step("z"))


#: DuckDB: frames with the row before them.
LAG = """, p AS (SELECT *, LAG(time_ms) OVER w AS pt, LAG(x) OVER w AS px, LAG(y) OVER w AS py, LAG(z) OVER w AS pz, LAG(vx) OVER w AS pvx, LAG(vy) OVER w AS pvy, LAG(vz) OVER w AS pvz,
  LAG(yaw) OVER w AS pyaw, LAG(pitch) OVER w AS ppitch, LAG(health) OVER w AS ph, LAG(armor) OVER w AS pa, LAG(flags) OVER w AS pf, LAG(label) OVER w AS pl, LAG(k) OVER w AS pk
  FROM t WINDOW w AS (PARTITION BY rec ORDER BY seq))
, q AS (SELECT *, time_ms - pt AS dt, SQRT((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz)) AS dist FROM p)"""


@query(f"{LAG}, c AS (SELECT *, COALESCE(dt BETWEEN 1 AND 250 AND dist <= 1.5*dt AND health > 0 AND ph > 0, FALSE) AS ok FROM q)"
       ", i AS (SELECT *, SUM(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM c)"
       " SELECT rec, CAST(island AS BIGINT) AS island, COUNT(*) AS n, MIN(time_ms) AS first_ms, MAX(time_ms) AS last_ms FROM i GROUP BY rec, island")  # fmt: skip
def continuity_islands(spark, sf):
    """G1: islands of frames that follow one another."""
    ok = islands.continuity(track(), "time_ms", _distance(), alive(), "context", per_ms=1.5)
    d = islands.add_islands(frames(spark, sf), ~ok, ["rec"], ["seq"])
    return d.groupBy("rec", "island").agg(F.count("*").alias("n"), F.min("time_ms").alias("first_ms"), F.max("time_ms").alias("last_ms"))


@query(f"{LAG} SELECT seq, COALESCE(dt = 100 AND ph > 0 AND health > 0 AND dist <= 60, FALSE) AS combat, COALESCE(dt BETWEEN 70 AND 130 AND ph > 0 AND health > 0 AND dist <= 45, FALSE) AS transition FROM q")
def continuity_flags(spark, sf):
    """The stricter continuity rules."""
    d = frames(spark, sf)
    return d.select("seq", islands.continuity(track(), "time_ms", _distance(), alive(), "combat", most=60.0).alias("combat"), islands.continuity(track(), "time_ms", _distance(), alive(), "transition", most=45.0).alias("transition"))


@query(f"{LAG}, c AS (SELECT *, COALESCE(dt BETWEEN 70 AND 130 AND ph > 0 AND health > 0, FALSE) AS ok FROM q)"
       ", i AS (SELECT *, SUM(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM c)"
       ", j AS (SELECT *, ROW_NUMBER() OVER v AS rn, LAG(seq, 4) OVER v AS first_seq, time_ms - LAG(time_ms, 3) OVER v AS horizon, LAG(vx, 3) OVER v AS past_vx FROM i WINDOW v AS (PARTITION BY rec, island ORDER BY seq))"
       " SELECT seq, first_seq, horizon, past_vx, vx AS target_vx FROM j WHERE rn >= 5 AND horizon BETWEEN 270 AND 330")  # fmt: skip
def sliding_history(spark, sf):
    """Five-row histories within islands."""
    ok = islands.continuity(track(), "time_ms", F.lit(0.0), alive(), "transition", most=1.0)
    d = islands.add_islands(frames(spark, sf), ~ok, ["rec"], ["seq"])
    d = islands.sliding(d, ["rec"], ["seq"], "island", 5, ["seq", "time_ms", "vx"])
    h = lambda i: F.get("history", i)
    d = d.withColumn("horizon", C("time_ms") - h(1)["time_ms"]).where("horizon BETWEEN 270 AND 330")
    return d.select("seq", h(0)["seq"].alias("first_seq"), "horizon", h(1)["vx"].alias("past_vx"), C("vx").alias("target_vx"))


WINDOW_ISLANDS = f"""{LAG}, f AS (SELECT *, COALESCE(dt BETWEEN 70 AND 130 AND ph > 0 AND health > 0, FALSE) AS cont, COALESCE(ph > 0 AND health <= 0 AND dt BETWEEN 70 AND 130, FALSE) AS dies FROM q)
, i AS (SELECT *, SUM(CASE WHEN cont OR dies THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM f)
, l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY rec, island ORDER BY seq) AS rn FROM i WHERE health > 0 OR dies)
, a AS (SELECT * FROM l WHERE health > 0 AND rn >= 2 AND time_ms % 300 = 0)
, pairs AS (SELECT a.seq AS anchor, a.rn AS arn, a.time_ms AS a_t, a.health AS ah, a.armor AS aa, b.rn AS brn, b.seq AS bseq, b.time_ms AS bt, b.dies AS bd, b.health AS bh, b.armor AS ba, b.label AS bl,
   (b.dies OR b.time_ms - a.time_ms >= 900) AS closing FROM a JOIN l b ON a.rec = b.rec AND a.island = b.island AND b.rn > a.rn AND b.rn <= a.rn + 43)
, ends AS (SELECT anchor, MIN(CASE WHEN closing THEN brn END) AS close_rn FROM pairs GROUP BY anchor)
, fut AS (SELECT pairs.*, close_rn FROM pairs JOIN ends USING (anchor) WHERE close_rn IS NULL OR brn <= close_rn)"""


def _windows(spark, sf):
    d = frames(spark, sf)
    follows = islands.continuity(track(), "time_ms", F.lit(0.0), alive(), "transition", most=1.0)
    return islands.observation_windows(
        d, ["rec"], "seq", "time_ms", F.lit(True), alive(), follows, ["seq", "time_ms", "health", "armor", "x", "y", "z", "vx", "vy", "vz", "yaw", "label"], context=8, horizon=900, anchor_ms=300
    )


@query(f"""{WINDOW_ISLANDS} SELECT anchor AS seq, CAST(LEAST(arn, 9) AS BIGINT) AS n_history, COUNT(*) AS n_future, MAX(bseq) AS last_seq, BOOL_OR(bd) AS terminal, ANY_VALUE(close_rn) IS NOT NULL AS complete
FROM fut GROUP BY anchor, arn""")
def observation_windows(spark, sf):
    """Living anchors with observed, censored or terminal futures."""
    d = _windows(spark, sf)
    return d.select("seq", F.size("history").cast("long").alias("n_history"), F.size("future").cast("long").alias("n_future"), F.element_at("future", -1)["seq"].alias("last_seq"), "terminal", "complete")


@query(f"""{WINDOW_ISLANDS}, ch AS (SELECT anchor, brn, bh, ba, bd, bt - a_t AS off, COALESCE(LAG(bh) OVER v, ah) AS h0, COALESCE(LAG(ba) OVER v, aa) AS a0 FROM fut WINDOW v AS (PARTITION BY anchor ORDER BY brn))
, e AS (SELECT anchor, BOOL_OR(bh <= 0) AS death, SUM(GREATEST(h0 - GREATEST(bh, 0), 0) + GREATEST(a0 - ba, 0)) >= 20 AS loss, BOOL_OR(bh > h0 OR ba > a0) AS gain, BOOL_OR(bh <= 0) OR BOOL_OR(off BETWEEN 900 AND 1000 AND bh > 0) AS complete FROM ch GROUP BY anchor)
SELECT anchor AS seq, death, loss, gain, death OR complete AS death_known, loss OR complete AS loss_known, gain OR complete AS gain_known FROM e""")
def event_labels(spark, sf):
    """Censoring-aware events: a positive is known even where the future is cut off."""
    d = _windows(spark, sf).withColumn("now", F.element_at("history", -1))
    d = d.withColumn("e", labels.event_labels(C("now"), C("future"), 20, 900, 1000))
    return d.select("seq", "e.*")


@query(f"""{WINDOW_ISLANDS}, s AS (SELECT anchor, MIN(CASE WHEN bt - a_t BETWEEN 270 AND 330 AND bh > 0 THEN brn END) AS r1, MIN(CASE WHEN bt - a_t BETWEEN 900 AND 1000 AND bh > 0 THEN brn END) AS r2 FROM fut GROUP BY anchor)
SELECT a.seq, ROUND((u.vx * COS(RADIANS(a.yaw)) + u.vy * SIN(RADIANS(a.yaw))) / 320, 6) + 0e0 AS forward, ROUND((-u.vx * SIN(RADIANS(a.yaw)) + u.vy * COS(RADIANS(a.yaw))) / 320, 6) + 0e0 AS left_,
 ROUND(((v.x - a.x) * COS(RADIANS(a.yaw)) + (v.y - a.y) * SIN(RADIANS(a.yaw))) / 1280, 6) + 0e0 AS moved_forward, CAST(v.health - a.health AS DOUBLE) / 100 AS d_health, u.seq IS NOT NULL AS soon_known, v.seq IS NOT NULL AS end_known
FROM s JOIN l a ON a.seq = s.anchor LEFT JOIN l u ON u.rec = a.rec AND u.island = a.island AND u.rn = s.r1 LEFT JOIN l v ON v.rec = a.rec AND v.island = a.island AND v.rn = s.r2""")
def motion_targets(spark, sf):
    """L1, L2: local velocity soon and displacement at the horizon, null where they weren't observed."""
    d = _windows(spark, sf).withColumn("now", F.element_at("history", -1))
    d = d.withColumn("v", labels.velocity_soon(C("future"), C("time_ms"), C("now.yaw"))).withColumn("m", labels.displacement(C("future"), C("now"), C("now.yaw"), 900, 1000))
    g = lambda a, i: F.round(F.get(a, i), 6) + 0.0
    return d.select("seq", g("v", 0).alias("forward"), g("v", 1).alias("left_"), g("m", 0).alias("moved_forward"), F.get("m", 3).alias("d_health"), C("v").isNotNull().alias("soon_known"), C("m").isNotNull().alias("end_known"))


@query(f"""{LAG}, c AS (SELECT *, COALESCE(dt BETWEEN 1 AND 250 AND ph > 0 AND health > 0, FALSE) AS ok FROM q)
, i AS (SELECT *, SUM(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM c)
, m AS (SELECT seq, time_ms - MAX(CASE WHEN event_type = 'purchase' THEN time_ms END) OVER v AS purchase, time_ms - MAX(CASE WHEN event_type = 'click' THEN time_ms END) OVER v AS click
  FROM i WINDOW v AS (PARTITION BY rec, island ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT seq, CASE WHEN purchase IS NOT NULL THEN LEAST(purchase, 300) END AS purchase_age, purchase IS NOT NULL AS purchase_age_known, ROUND(CASE WHEN purchase IS NULL THEN 0 ELSE LEAST(purchase, 400) / 400e0 END, 9) AS m_purchase, ROUND(CASE WHEN click IS NULL THEN 0 ELSE LEAST(click, 400) / 400e0 END, 9) AS m_click, CASE WHEN click IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS m_click_known FROM m""")
def causal_last_seen(spark, sf):
    """Time since something was last seen in this life, with a known bit."""
    ok = islands.continuity(track(), "time_ms", F.lit(0.0), alive(), "context", most=1.0)
    d = islands.add_islands(frames(spark, sf), ~ok, ["rec"], ["seq"])
    d = islands.since_last(d, ["rec"], ["seq"], "island", "time_ms", C("event_type") == "purchase", "purchase_age", 300)
    d = islands.memory(d, ["rec"], ["seq"], "island", "time_ms", "event_type", ["purchase", "click"], 400)
    m = lambda i: F.round(F.get("memory", i), 9)
    return d.select("seq", "purchase_age", "purchase_age_known", m(0).alias("m_purchase"), m(2).alias("m_click"), m(3).alias("m_click_known"))


@query(f"{LAG} SELECT seq, CASE WHEN health > 0 AND ph > 0 AND dt BETWEEN 70 AND 130 AND label > 0 AND label <> pl AND label >= 2 AND label < 5 THEN label END AS edge, COALESCE(ph > 0 AND health <= 0 AND dt BETWEEN 70 AND 130, FALSE) AS dies FROM q")
def label_edges(spark, sf):
    """Newly shown labels within a band, and deaths."""
    d = frames(spark, sf)
    return d.select("seq", islands.label_edges(track(), C("label"), alive(), "time_ms", (F.lit(2), F.lit(5))).alias("edge"), islands.deaths(track(), "health", "time_ms").alias("dies"))


def _event_sql():
    g, pg, held = GROUNDED, GROUNDED.replace("flags", "pf"), HELD
    return f"""{LAG}, m AS (SELECT *, pt IS NOT NULL AND ({held} OR (dt > 0 AND dt < 1000 AND dist > 1.5*dt)) AS warp, {g} AS g, {pg} AS pg FROM q)
, n AS (SELECT *, pt IS NOT NULL AND NOT warp AS go, SQRT((x-px)*(x-px)+(y-py)*(y-py)) AS xy, ROW_NUMBER() OVER (PARTITION BY rec ORDER BY seq) AS rn FROM m)
, r AS (SELECT rec, seq, rn, g, z, FALSE AS falling, z AS fall_from, CAST(NULL AS DOUBLE) AS fell FROM n WHERE rn = 1
  UNION ALL SELECT n.rec, n.seq, n.rn, n.g, n.z,
   CASE WHEN n.warp THEN FALSE WHEN n.pg AND NOT n.g THEN TRUE WHEN NOT n.pg AND n.g THEN FALSE ELSE r.falling END,
   CASE WHEN n.go AND n.pg AND NOT n.g THEN r.z WHEN n.go AND NOT n.g AND r.falling AND n.z > r.fall_from THEN n.z ELSE r.fall_from END,
   CASE WHEN n.go AND NOT n.pg AND n.g AND r.falling THEN r.fall_from - n.z END
  FROM r JOIN n ON n.rec = r.rec AND n.rn = r.rn + 1)
, e AS (SELECT rec, seq, time_ms, 'warp' AS kind, dist AS value FROM n WHERE warp
  UNION ALL SELECT rec, seq, time_ms, 'ride', xy FROM n WHERE go AND g AND pg AND xy > 8 AND SQRT(vx*vx+vy*vy) < 20
  UNION ALL SELECT rec, seq, time_ms, 'jump', vz FROM n WHERE go AND pg AND NOT g AND vz > 100
  UNION ALL SELECT rec, seq, time_ms, 'land', 0.0 FROM n WHERE go AND NOT pg AND g
  UNION ALL SELECT n.rec, n.seq, time_ms, 'drop', fell FROM n JOIN r USING (rec, seq) WHERE fell > 64)
SELECT rec, seq, time_ms, kind, ROUND(value, 6) AS value FROM e"""


@query(_event_sql())
def movement_events(spark, sf):
    """Jumps, landings, drops, warps and rides; the oracle walks the frames one by one."""
    d = frames(spark, sf).withColumn("g", ground()).withColumn("held", hold())
    return islands.movement_events(d, ["rec"], "seq", "time_ms", "x", "y", "z", "vx", "vy", "vz", "g", "held").withColumn("value", F.round("value", 6))


@query(f"{LAG}, i AS (SELECT *, SUM(CASE WHEN dt = 100 THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY time_ms ROWS UNBOUNDED PRECEDING) AS run FROM q), j AS (SELECT *, LAG(seq, 5) OVER (PARTITION BY rec, run ORDER BY time_ms) AS first_seq, ROW_NUMBER() OVER (PARTITION BY rec, run ORDER BY time_ms) AS rn FROM i)"
       " SELECT seq, first_seq FROM j WHERE rn >= 6 AND time_ms % 800 = 0")  # fmt: skip
def consecutive_runs(spark, sf):
    """Runs of rows exactly one step apart."""
    d = islands.runs_of(frames(spark, sf), ["rec"], "time_ms", 100, 6, 800, ["seq"])
    return d.select("seq", F.get("history", 0)["seq"].alias("first_seq"))


def _wrap(a, b):
    return f"(({a} - {b} + 180.0) - 360.0 * FLOOR(({a} - {b} + 180.0) / 360.0) - 180.0)"


@query(f"""{LAG}, r AS (SELECT *, COALESCE(dt BETWEEN 1 AND 250 AND dist <= 1.5*dt AND ph > 0 AND health > 0, FALSE) AS ok, dt / 1000.0 AS sec, {_wrap("yaw", "pyaw")} / (dt / 1000.0) AS yr, {_wrap("pitch", "ppitch")} / (dt / 1000.0) AS pr,
 SQRT(vx*vx+vy*vy) AS sp, SQRT(pvx*pvx+pvy*pvy) AS psp FROM q)
, s AS (SELECT *, LAG(ok) OVER w AS pok, LAG(yr) OVER w AS pyr, LAG(sec) OVER w AS psec FROM r WINDOW w AS (PARTITION BY rec ORDER BY seq))
SELECT seq, ROUND(yr, 6) AS yaw_rate, ROUND(pr, 6) AS pitch_rate, ROUND(CASE WHEN pok THEN (yr - pyr) / ((sec + psec) * 0.5) END, 4) AS yaw_accel, ROUND(sp, 6) AS speed_xy, ROUND(SQRT((vx-pvx)*(vx-pvx)+(vy-pvy)*(vy-pvy)) / sec, 6) AS accel_xy,
 ROUND(CASE WHEN NOT {GROUNDED} AND NOT {GROUNDED.replace("flags", "pf")} THEN sp - psp END, 6) AS air_speed_gain, ROUND(CASE WHEN sp > 20 THEN {_wrap("DEGREES(ATAN2(vy, vx))", "yaw")} END, 4) AS heading_view_delta,
 {GROUNDED.replace("flags", "pf")} AND NOT {GROUNDED} AND vz > 0 AS jump_candidate FROM s WHERE ok""")
def kinematics(spark, sf):
    """Rates, accelerations and jump candidates."""
    d = frames(spark, sf).withColumn("g", ground())
    ok = islands.continuity(track(), "time_ms", _distance(), alive(), "context", per_ms=1.5)
    d = islands.jump_candidate(islands.rates(d, ["rec"], "seq", "time_ms", "yaw", "pitch", "vx", "vy", "g", alive(), ok), "vz", "g")
    r = lambda c, n=6: F.round(c, n).alias(c)
    return d.select("seq", r("yaw_rate"), r("pitch_rate"), r("yaw_accel", 4), r("speed_xy"), r("accel_xy"), r("air_speed_gain"), r("heading_view_delta", 4), "jump_candidate")


@query(f"""{LAG}, c AS (SELECT *, ATAN2(px - x + 1, py - y + 2) AS b FROM q WHERE dt = 100)
SELECT seq, ROUND(-vx * SIN(b) + vy * COS(b), 5) + 0e0 AS lateral, ROUND(vx * COS(b) + vy * SIN(b), 5) + 0e0 AS radial, CASE WHEN dist <= 50 THEN (x - px) * 10 END AS enemy_vx FROM c""")
def bearing_speeds(spark, sf):
    """Speeds about a bearing, and a velocity from positions where the step is plausible."""
    d = frames(spark, sf)
    p = lambda c: F.lag(c).over(track())
    d = d.withColumn("dt", _step("time_ms")).withColumn("far", _distance()).withColumn("bx", p("y") - C("y") + 2).withColumn("by", p("x") - C("x") + 1).withColumn("evx", F.when(C("far") <= 50, (C("x") - p("x")) * 10)).where("dt = 100")
    lateral, radial = geometry.bearing_speeds(C("vx"), C("vy"), C("bx"), C("by"))
    return d.select("seq", (F.round(lateral, 5) + 0.0).alias("lateral"), (F.round(radial, 5) + 0.0).alias("radial"), C("evx").alias("enemy_vx"))


@query(f"{LAG} SELECT seq, time_ms FROM q WHERE health > 0 AND (pt IS NULL OR time_ms // 500 <> pt // 500)")
def bucket_downsample(spark, sf):
    """the first row of a bucket, if it is valid; an invalid one takes the bucket with it."""
    return filters.first_of_bucket(frames(spark, sf), ["rec"], ["seq"], "time_ms", 500, alive()).select("seq", "time_ms")


@query("SELECT seq, time_ms FROM t WHERE time_ms % 500 = 0")
def modular_anchors(spark, sf):
    """F6."""
    return filters.anchors(frames(spark, sf), "time_ms", 500).select("seq", "time_ms")


@query(", n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY rec ORDER BY seq) + CAST(concat('0x', substr(sha256(CAST(rec AS VARCHAR)), 1, 8)) AS BIGINT) % 7 AS i FROM t) SELECT rec, seq FROM n WHERE i % 7 = 0")
def strided_sample(spark, sf):
    """every seventh row of a recording, from an offset by its digest."""
    return filters.strided(frames(spark, sf), "rec", ["seq"], F.sha2(C("rec").cast("string"), 256), 7).select("rec", "seq")


@query(f"{LAG} SELECT rec, CAST(FLOOR(x / 32) AS BIGINT) AS cell_x, CAST(FLOOR(y / 32) AS BIGINT) AS cell_y, COUNT(*) AS frames, CAST(SUM(CASE WHEN {GROUNDED} THEN 1 ELSE 0 END) AS BIGINT) AS contacts FROM q GROUP BY 1, 2, 3")
def occupancy(spark, sf):
    """Frames and ground contacts by cell."""
    return A.occupancy(frames(spark, sf).withColumn("g", ground()), ["rec"], ["x", "y"], 32, "g")


@query(", p AS (SELECT *, LAG(event_type) OVER w AS from_state, time_ms - LAG(time_ms) OVER w AS dt FROM t WINDOW w AS (PARTITION BY rec ORDER BY seq)) SELECT from_state, event_type AS to_state, COUNT(*) AS n FROM p WHERE dt <= 250 AND from_state <> event_type GROUP BY 1, 2")
def transition_edges(spark, sf):
    """Moves between different states, none across a break."""
    return A.transitions(frames(spark, sf), ["rec"], ["seq"], C("event_type"), [], _step("time_ms") <= 250)


@query(", c AS (SELECT rec, seq, x, y, CAST(FLOOR(x / 64) AS BIGINT) AS cell_x, CAST(FLOOR(y / 64) AS BIGINT) AS cell_y FROM t), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY rec, cell_x, cell_y ORDER BY seq) AS rn FROM c)"
       ", b AS (SELECT rec, cell_x, cell_y, COUNT(*) AS n, ROUND(AVG(CASE WHEN rn <= 3 THEN x END), 6) AS mean_x, ROUND(AVG(CASE WHEN rn <= 3 THEN y END), 6) AS mean_y, MIN(seq) AS f FROM r GROUP BY 1, 2, 3)"
       " SELECT rec, cell_x, cell_y, n, mean_x, mean_y FROM b QUALIFY ROW_NUMBER() OVER (PARTITION BY rec ORDER BY f) <= 5")  # fmt: skip
def capped_cells(spark, sf):
    """The first cells of each recording, with the mean of their first positions."""
    d = A.capped_cells(frames(spark, sf), ["rec"], ["x", "y"], ["seq"], 64, 3, 5)
    return d.withColumn("mean_x", F.round("mean_x", 6)).withColumn("mean_y", F.round("mean_y", 6))


PHASE = "CASE event_type WHEN 'signup' THEN 'Countdown 3' WHEN 'view' THEN 'Match time' WHEN 'purchase' THEN 'Match End' WHEN 'click' THEN 'Overtime' ELSE 'x' END"


@query(f""", s AS (SELECT *, {PHASE} AS status FROM t), p AS (SELECT rec, seq, time_ms, CASE WHEN status LIKE 'Countdown%' THEN 'prelive' WHEN status LIKE 'Match End%' THEN 'post' WHEN status LIKE 'Match%' OR status LIKE 'Overtime%' THEN 'live' END AS phase FROM s)
, c AS (SELECT *, LAG(phase) OVER (PARTITION BY rec ORDER BY seq) AS was FROM p WHERE phase IS NOT NULL), d AS (SELECT *, LEAD(time_ms) OVER (PARTITION BY rec ORDER BY seq) AS end_ms FROM c WHERE was IS NULL OR was <> phase)
SELECT rec, ROW_NUMBER() OVER (PARTITION BY rec ORDER BY seq) AS epoch_id, time_ms AS start_ms, end_ms, CASE WHEN was IS NULL THEN 1 ELSE 2 END AS start_conf, end_ms IS NOT NULL AS closed FROM d WHERE phase = 'live'""")
def phase_epochs(spark, sf):
    """Live epochs from status texts."""
    return phases.epochs(frames(spark, sf), ["rec"], ["seq"], "time_ms", phases.phase_of(F.expr(PHASE)))


@query(""", s AS (SELECT *, event_type = 'error' AS free, CASE WHEN event_type <> 'error' THEN event_type || (k % 3) END AS alias FROM t)
, st AS (SELECT *, CASE WHEN NOT free AND COALESCE(LAG(free) OVER w, TRUE) THEN 1 ELSE 0 END AS b FROM s WINDOW w AS (PARTITION BY rec ORDER BY seq))
, g AS (SELECT *, SUM(b) OVER (PARTITION BY rec ORDER BY seq ROWS UNBOUNDED PRECEDING) AS track FROM st), n AS (SELECT rec, track, alias, MIN(seq) AS f FROM g WHERE track > 0 AND NOT free GROUP BY 1, 2, 3)
, k AS (SELECT rec, track, string_agg(alias, ',' ORDER BY f) AS aliases FROM (SELECT * FROM n QUALIFY ROW_NUMBER() OVER (PARTITION BY rec, track ORDER BY f) <= 4) z GROUP BY 1, 2)
SELECT g.rec, CAST(g.track AS BIGINT) AS track, MIN(time_ms) AS start_ms, COALESCE(MIN(CASE WHEN free THEN time_ms END), 0) AS identity_end_ms, ANY_VALUE(aliases) AS aliases FROM g JOIN k ON g.rec = k.rec AND g.track = k.track GROUP BY 1, 2""")
def identity_tracks(spark, sf):
    """Occupants of a slot with their first aliases."""
    d = frames(spark, sf).withColumn("alias", F.when(C("event_type") != "error", F.concat("event_type", (C("k") % 3).cast("string"))))
    out = phases.identity_tracks(d, ["rec"], ["seq"], "time_ms", "alias", C("event_type") == "error")
    return out.withColumn("aliases", F.array_join("aliases", ","))


@query(""", d AS (SELECT *, k - LAG(k) OVER (PARTITION BY rec ORDER BY seq) AS d FROM t)
SELECT rec, arg_min(k, seq) AS baseline, arg_max(k, seq) AS final, MIN(k) AS least, MAX(k) AS greatest, COUNT(CASE WHEN d <> 0 THEN 1 END) AS changes, CAST(SUM(CASE WHEN d > 0 THEN d ELSE 0 END) AS BIGINT) AS earned, CAST(SUM(CASE WHEN d < 0 THEN -d ELSE 0 END) AS BIGINT) AS penalties FROM d GROUP BY rec""")
def score_timeline(spark, sf):
    """G17."""
    return phases.score_timeline(frames(spark, sf), ["rec"], ["seq"], "k")


@query(f"{LAG}, n AS (SELECT *, CASE label WHEN 1 THEN 'Health' WHEN 2 THEN 'Cells' WHEN 3 THEN 'Slugs' ELSE NULL END AS name FROM q) SELECT rec, CASE WHEN name = 'Health' AND health - ph >= 50 THEN 'Mega Health' ELSE name END AS item, COUNT(*) AS n FROM n WHERE label > 0 AND (pl IS NULL OR pl <> label) AND name IS NOT NULL GROUP BY 1, 2")
def pickup_counts(spark, sf):
    """G18."""
    name = F.when(C("label") == 1, "Health").when(C("label") == 2, "Cells").when(C("label") == 3, "Slugs")
    return phases.pickup_counts(frames(spark, sf), ["rec"], ["seq"], "label", name, "health", ["rec"])


EPOCHS = ", e AS (SELECT rec, seq AS eid, time_ms AS start_ms, time_ms + 700 AS end_ms, CASE WHEN k % 2 = 0 THEN 0 ELSE time_ms + 300 END AS gone FROM t WHERE event_type = 'signup')"


def _epochs(d):
    e = d.where("event_type = 'signup'")
    return e.select("rec", C("seq").alias("eid"), C("time_ms").alias("start_ms"), (C("time_ms") + 700).alias("end_ms"), F.when(C("k") % 2 == 0, 0).otherwise(C("time_ms") + 300).alias("gone"))


@query(f"{EPOCHS} SELECT t.seq, COUNT(e.eid) AS n_covering, CASE WHEN COUNT(e.eid) = 1 THEN MIN(e.eid) END AS eid FROM t LEFT JOIN e ON t.rec = e.rec AND t.time_ms >= start_ms AND t.time_ms <= end_ms AND (gone = 0 OR t.time_ms < gone) GROUP BY t.seq")
def interval_attribution(spark, sf):
    """The one interval that covers a row; none or several stay unknown. Joined by time bins, so a key with very many rows and intervals is split."""
    d = frames(spark, sf)
    out = intervals.unique_interval(d.select("rec", "seq", "time_ms"), _epochs(d), ["rec"], ["seq"], "time_ms", "start_ms", "end_ms", ["eid"], identity_end="gone", bins=5000)
    return out.select("seq", "n_covering", "eid")


@query(f"{EPOCHS} SELECT t.seq, COUNT(e.eid) AS n_covering, CASE WHEN COUNT(e.eid) = 1 THEN MIN(e.eid) END AS eid FROM t LEFT JOIN e ON t.rec = e.rec AND t.time_ms >= start_ms AND t.time_ms < end_ms GROUP BY t.seq")
def interval_half_open(spark, sf):
    """Half-open intervals, joined by time bins."""
    d = frames(spark, sf)
    out = intervals.unique_interval(d.select("rec", "seq", "time_ms"), _epochs(d).drop("gone"), ["rec"], ["seq"], "time_ms", "start_ms", "end_ms", ["eid"], closed=False, bins=5000)
    return out.select("seq", "n_covering", "eid")


@query(", f AS (SELECT rec, seq, time_ms, event_type, MAX(CASE WHEN event_type = 'view' THEN seq END) OVER w AS last_view, MAX(CASE WHEN event_type = 'click' THEN seq END) OVER w AS last_click FROM t WINDOW w AS (PARTITION BY rec ORDER BY seq ROWS UNBOUNDED PRECEDING))"
       " SELECT f.seq, v.k AS view_k, c.k AS click_k FROM f LEFT JOIN t v ON v.seq = last_view LEFT JOIN t c ON c.seq = last_click WHERE f.event_type = 'purchase'")  # fmt: skip
def carry_forward(spark, sf):
    """Streams merged by seq, with the latest of each carried along."""
    d = frames(spark, sf)
    pick = lambda e, c: d.where(C("event_type") == e).select("rec", "seq", C("k").alias(c))
    m = asof.merge_streams({"view": pick("view", "vk"), "click": pick("click", "ck"), "purchase": d.where("event_type = 'purchase'").select("rec", "seq")}, ["rec"], "seq")
    m = asof.carry_forward(m, ["rec"], ["seq"], {"view_k": C("vk"), "click_k": C("ck")})
    return m.where("kind = 'purchase'").select("seq", "view_k", "click_k")


@query(", v AS (SELECT * FROM t WHERE event_type = 'view'), s AS (SELECT * FROM t WHERE event_type = 'purchase'), j AS (SELECT s.seq, s.time_ms, v.seq AS vseq, v.time_ms AS vt FROM s ASOF LEFT JOIN v ON s.rec = v.rec AND s.seq >= v.seq)"
       " SELECT seq, CASE WHEN time_ms - vt IN (0, 100, 300) THEN vseq END AS prior_seq FROM j")  # fmt: skip
def asof_backward(spark, sf):
    """The latest context of a shot, if its age is one of those allowed."""
    d = frames(spark, sf)
    out = asof.asof_backward(d.where("event_type = 'purchase'").select("rec", "seq", "time_ms"), d.where("event_type = 'view'"), ["rec"], ["seq"], ["seq"], ["seq"], ages=("time_ms", "time_ms", [0, 100, 300]))
    return out.select("seq", "prior_seq")


@query(", v AS (SELECT * FROM t WHERE event_type = 'purchase'), s AS (SELECT * FROM t WHERE event_type = 'view'), j AS (SELECT s.seq, s.time_ms, v.seq AS vseq, v.time_ms AS vt, v.k AS vk FROM s ASOF LEFT JOIN v ON s.rec = v.rec AND s.seq < v.seq)"
       " SELECT seq, CASE WHEN vt - time_ms BETWEEN 0 AND 400 THEN vk END AS next_k FROM j")  # fmt: skip
def asof_forward(spark, sf):
    """The first shot behind an anchor, within the horizon."""
    d = frames(spark, sf)
    out = asof.asof_forward(d.where("event_type = 'view'").select("rec", "seq", "time_ms"), d, ["rec"], "seq", "time_ms", 400, ["k"], C("event_type") == "purchase")
    return out.select("seq", "next_k")


@query(f"{LAG} SELECT seq, CASE WHEN dt = 100 THEN px END AS prev_x FROM q")
def adjacent_rows(spark, sf):
    """The row before, only where it is exactly one step earlier."""
    return asof.adjacent(frames(spark, sf), ["rec"], "time_ms", 100, ["x"]).select("seq", "prev_x")


@query("SELECT a.seq, b.k % 2 AS enemy_slot, b.seq AS enemy_seq FROM t a JOIN t b ON a.rec = b.rec AND a.time_ms // 1000 = b.time_ms // 1000 AND a.k % 2 <> b.k % 2")
def opponent_pairs(spark, sf):
    """Both directions of the pairs of an epoch."""
    d = frames(spark, sf).select("rec", F.floor(C("time_ms") / 1000).alias("epoch"), (C("k") % 2).alias("slot"), "seq")
    return asof.opponents(d, ["rec", "epoch"], "slot", ["seq"]).select("seq", "enemy_slot", "enemy_seq")


@query(", s AS (SELECT rec, label AS idx, seq, event_type AS text FROM t WHERE event_type <> 'view'), r AS (SELECT rec, label AS idx, seq FROM t WHERE event_type = 'view') SELECT r.seq, s.text AS name FROM r ASOF LEFT JOIN s ON r.rec = s.rec AND r.idx = s.idx AND r.seq >= s.seq")
def dictionary_asof(spark, sf):
    """What a setting's number last stood for."""
    d = frames(spark, sf).withColumnRenamed("label", "idx")
    out = asof.dictionary_asof(d.where("event_type = 'view'").select("rec", "idx", "seq"), d.where("event_type <> 'view'").select("rec", "idx", "seq", C("event_type").alias("text")), ["rec"], "idx", "seq", "text", "name")
    return out.select("seq", "name")


@query(f"""{LAG}, b AS (SELECT seq, (vx*(px-x+20)+vy*(py-y+300)) / d AS radial, (-vx*(py-y+300)+vy*(px-x+20)) / d AS side, SQRT(vx*vx+vy*vy) AS speed, d, pz - z AS dz, health, armor FROM (SELECT *, SQRT((px-x+20)*(px-x+20)+(py-y+300)*(py-y+300)) AS d FROM q WHERE pt IS NOT NULL) u)
SELECT seq, CASE WHEN d < 256 THEN 'near' WHEN d < 640 THEN 'medium' ELSE 'far' END AS "range", CASE WHEN health <= 40 THEN 'critical' ELSE 'normal' END AS health_state, CASE WHEN armor > 0 THEN 'present' ELSE 'absent' END AS armor_state,
 CASE WHEN dz > 64 THEN 'above' WHEN dz < -64 THEN 'below' ELSE 'same_level' END AS height, CASE WHEN speed < 40 THEN 'stationary' WHEN radial > 60 AND radial > ABS(side) THEN 'approaching' WHEN radial < -60 AND -radial > ABS(side) THEN 'separating' ELSE 'lateral' END AS movement FROM b""")
def behaviour_buckets(spark, sf):
    """Condition buckets of motion relative to an enemy."""
    p = lambda c: F.lag(c).over(track())
    d = frames(spark, sf).withColumn("dx", p("x") - C("x") + 20).withColumn("dy", p("y") - C("y") + 300).withColumn("dz", p("z") - C("z")).where("dx IS NOT NULL")
    b = geometry.behaviour([C("dx"), C("dy"), C("dz")], [C("vx"), C("vy"), C("vz")], C("health"), C("armor"), F.lit(True), F.lit(True))
    return d.select("seq", *(b[n].alias(n) for n in ("range", "health_state", "armor_state", "height", "movement")))


@query(f"{LAG}" + """ SELECT seq, ROUND((vx*COS(RADIANS(yaw))+vy*SIN(RADIANS(yaw)))/320, 6) + 0e0 AS f0, ROUND((-pvx*SIN(RADIANS(yaw))+pvy*COS(RADIANS(yaw)))/320, 6) + 0e0 AS f4, ROUND(pitch/90, 6) + 0e0 AS f6, CAST(health/200.0 AS DOUBLE) AS f8,
 CASE WHEN event_type='click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f15, 26 AS width FROM q WHERE dt = 100""")
def motion_features(spark, sf):
    """The 26 motion features; some are shown."""
    weapons = ["click", "view", "error", "purchase", "signup", *(f"w{i}" for i in range(6))]
    cols = ["x", "y", "z", "vx", "vy", "vz", "yaw", "pitch", "health", "armor"]
    nothing = [F.lit(None).cast("double").alias(c) for c in ("yaw_rate", "ex", "ey", "ez")]
    d = frames(spark, sf).withColumn("s", F.struct(*cols, *nothing, ground().alias("grounded"), C("event_type").alias("weapon")))
    d = d.withColumn("p", F.lag("s").over(track())).withColumn("dt", _step("time_ms")).where("dt = 100")
    d = d.withColumn("f", encode.motion_features(C("p"), C("s"), weapons))
    g = lambda i: F.get("f", i)
    return d.select("seq", (F.round(g(0), 6) + 0.0).alias("f0"), (F.round(g(4), 6) + 0.0).alias("f4"), (F.round(g(6), 6) + 0.0).alias("f6"), g(8).alias("f8"), g(15).alias("f15"), F.size("f").alias("width"))


@query(f"""{LAG}, b AS (SELECT i AS id, CAST(i * 150 AS DOUBLE) AS lx, CAST(i * 150 + 20 AS DOUBLE) AS hx FROM range(0, 12) r(i))
SELECT q.seq, COUNT(*) AS hits, CAST(SUM(b.id) AS BIGINT) AS id_sum FROM q JOIN b ON GREATEST(0, CASE WHEN ABS(x-px) < 1e-9 THEN 0 ELSE LEAST((lx-16-px)/(x-px), (hx+16-px)/(x-px)) END) <= LEAST(1, CASE WHEN ABS(x-px) < 1e-9 THEN 1 ELSE GREATEST((lx-16-px)/(x-px), (hx+16-px)/(x-px)) END)
 AND (ABS(x-px) >= 1e-9 OR (px >= lx-16 AND px <= hx+16)) WHERE q.pt IS NOT NULL GROUP BY q.seq""")
def hull_hits(spark, sf):
    """M7: steps of a player's hull that meet boxes."""
    p = lambda c: F.lag(c).over(track())
    d = frames(spark, sf).withColumn("px", p("x")).where("px IS NOT NULL").select("seq", "x", "px")
    boxes = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(i * 150.0).alias("lx"), F.lit(i * 150.0 + 20).alias("hx")) for i in range(12)))
    far = [F.lit(-1e6), F.lit(1e6)]
    hit = F.filter(boxes, lambda b: geometry.swept_hull([C("px"), F.lit(0.0), F.lit(0.0)], [C("x"), F.lit(0.0), F.lit(0.0)], [b["lx"], far[0], far[0]], [b["hx"], far[1], far[1]]))
    d = d.withColumn("hit", hit).where(F.size("hit") > 0)
    return d.select("seq", F.size("hit").cast("long").alias("hits"), F.aggregate("hit", F.lit(0).cast("long"), lambda a, b: a + b["id"]).alias("id_sum"))


@query("SELECT seq, ROUND(yaw - pitch * 4 + 180 - 360 * FLOOR((yaw - pitch * 4 + 180) / 360) - 180, 6) AS wrapped, LEAST(GREATEST(vx, -100.0), 100.0) AS clipped, ROUND(1 / (1 + EXP(-LEAST(GREATEST(vx / 10, -30.0), 30.0))), 9) AS sigmoid,"
       " CAST(concat('0x', substr(sha256(CAST(seq AS VARCHAR)), 1, 8)) AS BIGINT) % 10 AS bucket, ROUND(LN(GREATEST(x, 1e-9)), 6) AS logx, ROUND(SQRT(x*x + y*y), 6) AS speed FROM t")  # fmt: skip
def scalar_functions(spark, sf):
    """M1, M4, M5, M10, M12."""
    v = F.array("x", "y", "z")
    return frames(spark, sf).select(
        "seq", F.round(S.angle_diff(C("yaw"), C("pitch") * 4), 6).alias("wrapped"), S.clip("vx", -100.0, 100.0).alias("clipped"), F.round(S.sigmoid(C("vx") / 10), 9).alias("sigmoid"),
        S.hex_bucket(F.sha2(C("seq").cast("string"), 256), 10).alias("bucket"), F.round(S.safe_log("x"), 6).alias("logx"), F.round(S.speed_xy(v), 6).alias("speed"),
    )


@query("SELECT rec, MIN(time_ms) AS first_ms, MAX(time_ms) AS last_ms, MAX(time_ms) - MIN(time_ms) AS duration_ms FROM t GROUP BY rec")
def time_spans(spark, sf):
    """W7, C23."""
    return phases.spans(frames(spark, sf), ["rec"], "time_ms")


@query(", r AS (SELECT rec, seq, k, ROW_NUMBER() OVER (PARTITION BY rec ORDER BY seq) AS rn FROM t) SELECT rec, COUNT(*) AS n, COUNT(CASE WHEN rn <= 16 THEN 1 END) AS listed, MAX(CASE WHEN rn <= 16 THEN seq END) AS last_listed FROM r GROUP BY rec")
def capped_events(spark, sf):
    """Counts keep counting beyond a capped list."""
    d = A.capped_events(frames(spark, sf), ["rec"], ["seq"], ["seq"], 16)
    return d.select("rec", "n", F.size("events").cast("long").alias("listed"), F.element_at("events", -1)["seq"].alias("last_listed"))
