"""Widths and values of the feature encoders, labels at the edges of what was observed, replay and roles."""

import pytest
from pyspark.sql import functions as F

from tidewake.functions.text import ITEMS, WEAPONS
from tidewake.operators import encode, geometry, labels, sampling

ROW = dict(
    x=1.0, y=2.0, z=3.0, vx=320.0, vy=0.0, vz=0.0, yaw=0.0, pitch=45.0, yaw_rate=None, health=100, armor=50, grounded=True, weapon="railgun", ex=None, ey=None, ez=None, clear=True, complete=False, in_view=None, eye_known=True,
    rockets=40, grenades=None, ammo=0, shot_age_ms=None, evx=None, evy=None, evz=None, gunframe=None, held=False, gravity=800,
)
SCHEMA = "x double, y double, z double, vx double, vy double, vz double, yaw double, pitch double, yaw_rate double, health int, armor int, grounded boolean, weapon string, ex double, ey double, ez double, clear boolean, complete boolean, in_view boolean, eye_known boolean, rockets int, grenades int, ammo int, shot_age_ms int, evx double, evy double, evz double, gunframe int, held boolean, gravity int"


@pytest.fixture(scope="module")
def row(spark):
    return spark.createDataFrame([tuple(ROW.values())], SCHEMA).select(F.struct("*").alias("r"), F.lit(None).cast("struct<x:double,y:double,z:double>").alias("none"), F.struct(F.lit(1281.0).alias("x"), F.lit(2.0).alias("y"), F.lit(3.0).alias("z")).alias("near"))


def test_sequence_step(row):
    points = [F.col("near")] + [F.col("none")] * 13
    v = row.select(encode.sequence_step(F.col("r"), F.col("r"), WEAPONS, points)).first()[0]
    assert len(v) == 97 and all(isinstance(x, float) for x in v)
    assert v[:3] == [1.0, 0.0, 0.0] and v[6:12] == [0.5, 0.0, 0.5, 0.25, 1.0, 0.0]
    assert sum(v[15:26]) == 1 and v[15 + WEAPONS.index("railgun")] == 1
    assert v[26:32] == [1.0, 0.0, 0.0, 1.0, 1.0, 0.0]  # forty rockets count as twenty
    assert v[32:40] == [1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    assert v[88:] == [0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]  # no ammunition is known, an unseen shot isn't


def test_decision_and_mechanism_steps(row):
    none = [F.col("none")]
    memory = F.array(*[F.lit(0.0)] * 2 * (len(WEAPONS) + len(ITEMS)))
    v = row.select(encode.decision_step(F.col("r"), F.col("r"), WEAPONS, none * 14, none * 23, none * 23, memory)).first()[0]
    assert len(v) == 351 and len(ITEMS) == 23
    box = F.struct(*(F.lit(float(n)).alias(c) for c, n in zip(("lx", "ly", "lz", "hx", "hy", "hz", "tx", "ty", "tz"), (0, 0, 0, 2, 4, 6, 1281, 2, 3))))
    nothing = F.lit(None).cast("struct<lx:double,ly:double,lz:double,hx:double,hy:double,hz:double,tx:double,ty:double,tz:double>")
    v = row.select(encode.mechanism_step(F.col("r"), box, nothing)).first()[0]
    assert len(v) == 26 and v[:3] == [0.32, 0.0, 0.0] and v[11:18] == [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0] and v[18:] == [0.0] * 7 + [1.0]


FUTURE = "array<struct<time_ms:long,health:int,armor:int,pickup:string,pickup_known:boolean>>"


def test_labels(spark):
    r = lambda t, h=100, a=0, p=None, k=True: (t, h, a, p, k)
    full = [r(t) for t in range(100, 3001, 100)]
    cases = {
        "quiet": full,
        "censored": full[:3],
        "hurt": [r(100), r(200, 80)],
        "decay": [r(t, 150 - i) for i, t in enumerate(range(100, 3001, 100))],
        "death": [r(100, 0)],
        "picked": [r(100), r(200, p="item_pack")],
        "unseen": [*full[:-1], r(3000, k=False)],
    }
    df = spark.createDataFrame([(n, f) for n, f in cases.items()], f"n string, f {FUTURE}")
    start = {"decay": 151}
    now = F.struct(F.lit(0).cast("long").alias("time_ms"), F.when(F.col("n") == "decay", start["decay"]).otherwise(100).alias("health"), F.lit(0).alias("armor"))
    got = {x.n: (tuple(x.e), x.p) for x in df.select("n", labels.event_labels(now, F.col("f")).alias("e"), labels.next_pickup(F.col("f"), F.lit(0)).alias("p")).collect()}
    assert got["quiet"] == ((False, False, False, True, True, True), "none")
    assert got["censored"] == ((False, False, False, False, False, False), None)
    assert got["hurt"] == ((False, True, False, False, True, False), None)  # a loss is known though the future is cut off
    assert got["decay"] == ((False, True, False, True, True, True), "none")  # thirty points of decay in all
    assert got["death"] == ((True, True, False, True, True, True), "none")
    assert got["picked"][1] == "item_pack" and got["unseen"][1] is None


def test_mechanism_windows(spark):
    """A teleport goes on with the window and is its event; a gap ends it without one."""
    rows = [("a", s, s * 100, 1.0, s != 6, "teleport" if s == 3 else "ordinary" if s != 6 else "gap") for s in range(12)]
    df = spark.createDataFrame(rows, "k string, seq int, time_ms long, x double, known boolean, kind string").withColumn("edge", F.struct("known", "kind")).withColumn("alive", F.lit(True)).withColumn("health", F.lit(100))
    got = {r.seq: (len(r.history), [f.kind for f in r.future], r.complete) for r in geometry.mechanism_windows(df, ["k"], "seq", "edge", ["time_ms", "kind", "health"], 4).collect()}
    assert got[0] == (1, ["ordinary", "ordinary", "teleport", "ordinary", "ordinary"], False)
    assert got[4] == (4, ["ordinary"], False) and 6 in got and got[6][0] == 1


def test_contexts_and_neighbours(spark):
    c = lambda *v: geometry.visibility(*(F.lit(x).cast("boolean") for x in v))
    got = spark.range(1).select(c(None, True, True, True, True, False), c(True, False, True, True, True, False), c(True, True, False, True, True, False), c(True, True, True, False, True, False), c(True, True, True, True, False, False), c(True, True, True, True, True, True), c(True, True, True, True, True, False)).first()
    assert list(got) == ["enemy_absent", "camera_unknown", "world_occluded", "horizontal_offscreen", "mover_unknown", "mvd_visibility_unknown", "clear_center_candidate"]
    pairs = spark.createDataFrame([(0, i, float(i % 4)) for i in range(8)], "node int, other int, d double")
    assert sorted(r.other for r in geometry.neighbours(pairs, "node", "other", "d", 2, 3).collect()) == [1, 2, 5]
    env = lambda low, high, t=False: F.struct(F.array(*map(F.lit, low)).alias("low"), F.array(*map(F.lit, high)).alias("high"), F.lit(t).alias("transparent"))
    ray = [F.lit(0.0)] * 3, [F.lit(10.0), F.lit(0.0), F.lit(0.0)]
    hit, miss, glass = env((4.0, -1.0, -1.0), (5.0, 1.0, 1.0)), env((4.0, 2.0, -1.0), (5.0, 3.0, 1.0)), env((4.0, -1.0, -1.0), (5.0, 1.0, 1.0), True)
    got = spark.range(1).select(*(geometry.collision_complete(*ray, F.array(*e)) for e in ((miss,), (miss, hit), (glass, miss)))).first()
    assert list(got) == [True, False, True]


def test_replay_policies(spark):
    rows = lambda n, split, m: [(f"{split}{m}{i}", m, split, i) for i in range(n)]
    old = spark.createDataFrame(rows(30, "train", "a") + rows(30, "test", "a"), "id string, map string, split string, v int")
    new = spark.createDataFrame(rows(40, "train", "b"), old.schema)
    count = lambda d: {(r.map, r.split): r["count"] for r in d.groupBy("map", "split").count().collect()}
    assert count(sampling.replay_merge(old, new, "id", "map", 20, "split")) == {("a", "train"): 10, ("b", "train"): 10, ("a", "test"): 20}
    assert count(sampling.replay_merge(old, new, "id", "map", 1, "split", policy="train", least=1)) == {("a", "train"): 1, ("b", "train"): 1, ("a", "test"): 30}
    with pytest.raises(ValueError):
        sampling.assert_no_leaks(spark.createDataFrame([("g", "train"), ("g", "test")], "g string, s string"), "g", "s")
