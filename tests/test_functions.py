"""Column builders against plain Python, at their edges."""

import math

from pyspark.sql import functions as F

from tidewake.functions import scalars as S
from tidewake.functions import text as X
from tidewake.operators import encode, filters, geometry, metrics


def values(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


def test_angles(spark):
    for a, b in ((190.0, -190.0), (-180.0, 0.0), (180.0, 0.0), (359.0, 1.0), (-725.5, 10.0)):
        floored, folded = values(spark, S.angle_diff(F.lit(a), F.lit(b)), S.angle_diff_folded(F.lit(a), F.lit(b)))
        d = math.fmod(a - b, 360)
        assert floored == (a - b + 180) % 360 - 180 and folded == (d - 360 if d > 180 else d + 360 if d < -180 else d)


def test_vectors(spark):
    v = lambda *x: F.array(*(F.lit(y).cast("double") for y in x))
    got = values(spark, S.finite(v(1, 2, 3)), S.finite(v(1, None, 3)), S.finite(v(1, 2)), S.finite(v(1, float("nan"), 3)), S.finite(v(1, 2, float("inf"))), S.dist(v(0, 0, 0), v(2, 3, 6)), S.speed_xy(v(3, 4, 9)))
    assert got == [True, False, False, False, False, 7.0, 5.0]
    assert values(spark, *S.push_direction(F.lit(0.0), F.lit(-1.0), F.lit(0.0)), *S.push_direction(F.lit(0.0), F.lit(0.0), F.lit(0.0)), *S.push_direction(F.lit(0.0), F.lit(-2.0), F.lit(0.0))) == [0, 0, 1, 0, 0, 0, 0, 0, -1]
    x, y, z = values(spark, *S.push_direction(F.lit(30.0), F.lit(90.0), F.lit(0.0)))
    assert abs(x) < 1e-9 and math.isclose(y, math.cos(math.radians(30))) and math.isclose(z, -0.5)


def test_arrays(spark):
    got = values(spark, S.one_hot(F.lit("b"), ["a", "b"]), S.one_hot(F.lit(None), ["a", "b"]), S.left_pad(F.array(F.lit(1), F.lit(2), F.lit(3)), 2, F.lit(0)), S.left_pad(F.array(F.lit(1)), 3, F.lit(0)), S.clip(F.lit(None).cast("double"), 0.0, 1.0))
    assert got == [[0.0, 1.0], [0.0, 0.0], [2, 3], [0, 0, 1], None]
    p, logits = values(spark, S.softmax(F.array(F.lit(1000.0), F.lit(1000.0))), S.corrected(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0), F.lit(4.0)), F.array(F.lit(0), F.lit(1)), 2.0))
    assert p == [0.5, 0.5] and logits[0] == 1.0 and math.isclose(logits[1], 2 - math.log(4) - math.log(2))
    assert values(spark, encode.standardise(F.array(F.lit(1.0), F.lit(9.0)), F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))) == [[0.5, 10.0]]
    assert values(spark, metrics.selection_score([F.lit(0.5), F.lit(9.0), F.lit(None).cast("double")]), metrics.selection_score([F.lit(None).cast("double")])) == [1.25, None]


def test_predicates(spark):
    stats = lambda **k: F.array(*(F.lit(k.get(f"s{i}", 0)) for i in range(k.get("n", 18))))
    row = lambda pm, st, flags=0: spark.range(1).select(F.lit(pm).alias("p"), st.alias("s"), F.lit(flags).alias("f"), F.array(*map(F.lit, (1.0, 2.0, 3.0))).alias("o"))
    ok = lambda d: d.select(filters.actor_valid("p", "s", "o"), filters.actor_moving("p", "s", "f", "o")).first()
    assert tuple(ok(row(0, stats(s1=5)))) == (True, True) and tuple(ok(row(0, stats(s1=5), 32))) == (True, False) and tuple(ok(row(0, stats()))) == (True, False)
    assert tuple(ok(row(1, stats(s1=5)))) == tuple(ok(row(0, stats(s17=1)))) == tuple(ok(row(0, stats(n=17)))) == (False, False)
    scans = spark.createDataFrame([(0, 0, ["q2dm1"]), (0, 0, ["q2dm8"]), (0, 1, ["q2dm8"]), (0, 0, []), (None, 0, ["q2dm8"])], "code int, quality int, maps array<string>")
    scans = scans.crossJoin(spark.createDataFrame([(True,), (False,)], "complete boolean")).orderBy(F.desc("complete"), F.col("code").isNull(), "quality", F.desc(F.size("maps")), "maps")
    skip = filters.can_skip(scans, ["q2dm1"], "code", "quality", "maps", "complete").where("skip").collect()
    assert [(r.code, r.quality, r.maps, r.complete) for r in skip] == [(0, 0, ["q2dm8"], True)]  # a scan that stopped early is never skipped
    assert filters.wanted_maps(spark.createDataFrame([("a",), ("b",)], "map string"), ["b"]).count() == 1


def test_recognisers(spark):
    paths = ["models/weapons/g_shotg2/tris.md2", "models/items/ammo/cells/medium/tris.md2", "models/items/armor/body/tris.md2", "models/items/healing/large/tris.md2", "models/items/mega_h/tris.md2", "models/x.md2"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(X.item_of_model("p")).collect()]
    assert got == ["weapon_supershotgun", "ammo_cells", "item_armor_body", "item_health", "item_health_mega", None]
    assert values(spark, X.view_weapon(F.lit("models/weapons/v_rail/tris.md2")), X.flash_weapon(F.lit(134)), X.flash_weapon(F.lit(9)), X.pickup_item(F.lit(" HEALTH ")), X.escaped_json_string(F.lit('é"'))) == ["railgun", "railgun", None, "item_health", '"\\u00e9\\""']
    line = lambda s: F.lit(s)
    got = values(spark, X.is_obituary(line("a was railed by b")), X.is_obituary(line("(a) was railed by b")), X.is_obituary(line("a: killed by b")), X.obituary_names(line("pogos was railed by pogo"), F.array(F.lit("pogo"), F.lit("pogos"))), X.obituary_weapon(line("a ate b's rocket")))
    assert got[:3] == [True, False, False] and got[3] is None and got[4] == "rocket_launcher"
    assert tuple(values(spark, X.obituary_names(line("ann was railed by bob"), F.array(F.lit("bob"), F.lit("ann"), F.lit("an"))))[0]) == ("ann", "bob")


def test_rays_and_candidates(spark):
    plane = lambda nx, ny, nz, d: F.struct(F.lit(float(nx)).alias("nx"), F.lit(float(ny)).alias("ny"), F.lit(float(nz)).alias("nz"), F.lit(float(d)).alias("d"))
    cube = F.array(F.array(*(plane(*n, 1) for n in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))))
    p = lambda *v: [F.lit(float(x)) for x in v]
    cases = [(p(-5, 0, 0), p(5, 0, 0)), (p(-5, 2, 0), p(5, 2, 0)), (p(0, 0, 0), p(9, 0, 0)), (p(-5, 0, 0), p(-2, 0, 0)), (p(-3, 0, 0), p(0, 3, 0)), (p(-2, 0, 0), p(0, 1.5, 0))]
    assert values(spark, *(geometry.ray_clear(a, b, cube) for a, b in cases)) == [False, True, False, True, True, False]
    grid = spark.createDataFrame([(f, s) for f in (-400, 0, 400) for s in (-400, 0, 400)], "forward int, side int")
    rows = spark.createDataFrame([(390, 10), (-1, -399), (200, 0)], "a int, b int")
    got = geometry.best_candidate(rows, grid, lambda c: F.abs(F.col("a") - c["forward"]) + F.abs(F.col("b") - c["side"])).select("best.candidate.*").collect()
    assert [tuple(r) for r in got] == [(400, 0), (0, -400), (0, 0)]
