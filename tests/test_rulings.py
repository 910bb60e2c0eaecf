"""Errors and orders that queries over the given tables don't show."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewake.functions import scalars
from tidewake.functions.text import nickname_of
from tidewake.operators import geometry, rulings, sampling
from tidewake.session import shared_folder
from tidewake.sources import demos, maps
from tidewake.streaming import lives


def test_shots_without_epoch(spark):
    shots = spark.createDataFrame([(1, 0, 5), (1, None, 6)], "rec int, epoch int, seq int")
    assert [r.shot for r in rulings.shot_tracks(shots.where("epoch = 0"), ["rec"], "epoch", "seq").collect()] == [0]
    with pytest.raises(PySparkException, match="no epoch"):
        rulings.shot_tracks(shots, ["rec"], "epoch", "seq").collect()


def test_late_rows_by_arrival(spark, tmp_path):
    """However rows fall into batches, the same ones are late."""
    rows = [(1, s, 100 * s, 50, i) for i, s in enumerate((1, 2, 4, 3, 5, 5, 9, 10))]
    schema = "rec long, seq long, time_ms long, health long, came long"
    results = []
    for name, cuts in (("one", [8]), ("two", [3, 8]), ("each", range(1, 9))):
        start, got = 0, None
        for end in cuts:
            spark.createDataFrame(rows[start:end], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            start = end
            stream = lives.lives(lives.watch(spark, f"{tmp_path}/{name}/in", schema), 250, "came")
            assert lives.ingest(stream, f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/cp").awaitTermination(120) in (True, None)
        got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}/out").collect())
        results.append(got)
    assert results[0] == results[1] == results[2]
    assert [(r[2], r[5]) for r in results[0]] == [(100, "gap"), (300, "late"), (500, "late")]


def test_replay_ties(spark):
    """Two new rows of one identity: the same one is taken, whatever the order."""
    old = spark.createDataFrame([(1, "m", "x")], "id int, map string, v string")
    new = spark.createDataFrame([(1, "m", "a"), (1, "m", "b"), (1, "m", "c")], "id int, map string, v string")
    got = {sampling.replay_merge(old, d, "id", "map", 9).first().v for d in (new, new.orderBy(F.desc("v")), new.repartition(3))}
    assert len(got) == 1 and got < {"a", "b", "c"}
    assert [r.id for r in sampling.conflicts(old, new, "id", ["v"]).collect()] == [1]


def test_broadcast_sizes(spark):
    assert geometry.small(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        geometry.small(spark.range(6), 5)


def test_vectors(spark):
    texts = ["1 2 3", " 1\t2  -3.5 ", "1 2", "1 2 3 4", "a b c", "1 2 inf", "1 2 nan", "0 0 65536", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.vector("t").alias("v"))
    assert [r.v for r in df.collect()] == [[1.0, 2.0, 3.0], [1.0, 2.0, -3.5]] + [None] * 8


def test_names_and_entities():
    assert nickname_of("^1Play^^2er^") == "player" and nickname_of("Ａ^9ŉx") == "a\u02bcnx" and nickname_of("\xd0x") == "px"
    good = '{ "classname" "worldspawn" "message" "a \\" b" }\n{"classname" "x"}'
    assert maps.entities(good) == [{"classname": "worldspawn", "message": 'a \\" b'}, {"classname": "x"}]
    for bad in ('{ "classname" "worldspawn" ', '{{ "classname" "worldspawn" }}', '{ "classname" "worldspawn" "x" }', '{ "classname" "x" }', "", '{ "classname" "worldspawn', "}"):
        with pytest.raises(maps.MapError):
            maps.entities(bad)


def test_shared_folder(spark):
    assert shared_folder(spark)


def test_corrected_choice_of_unknown_classes(spark):
    train = spark.createDataFrame([(0, 1), (0, 0), (0, -1), (2, 2)], "y int, cur int")
    rows = spark.createDataFrame([([0.0, 0.0, 0.0], -1), ([0.0, 5.0, 0.0], 1), ([1.0, 1.0, 1.0], 2)], "z array<double>, cur int")
    got = rulings.corrected_choice(rows, train, "z", "y", "cur").collect()
    assert [r.choice for r in got][1] == 1 and len(got) == 3


def test_cancelled_streams(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    stream = lives.watch(spark, f"{tmp_path}/in", "id long")
    asked = []
    endless = lives.ingest(stream, f"{tmp_path}/a", f"{tmp_path}/ca", every="1 second")
    assert lives.run_until(endless, lambda: asked.append(1) or len(asked) > 2, 0.5) == "cancelled" and not endless.isActive
    assert lives.run_until(lives.ingest(stream, f"{tmp_path}/b", f"{tmp_path}/cb"), lambda: False, 0.5) == "completed"
    assert spark.read.parquet(f"{tmp_path}/b").count() == 3


def test_headers_of_bytes(spark):
    import struct

    raw = b"".join(struct.pack("<i", len(p)) + p for p in (bytes([12]) + struct.pack("<iiB", 34, 1, 1) + b"g\0" + struct.pack("<h", 0) + b"l\0", bytes([13]) + struct.pack("<H", 33) + b"maps/a.bsp\0", bytes([20])))
    df = spark.createDataFrame([("x", bytearray(raw)), ("y", None)], "content_sha string, content binary")
    got = demos.headers(df).collect()
    assert [(r.content_sha, r.protocol, r.maps, r.complete) for r in got] == [("x", 34, ["a"], False)]
