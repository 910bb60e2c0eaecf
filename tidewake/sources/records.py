"""The record stream: one JSON object a line with kind, seq, segment and time_ms, split into typed tables and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("segment", T.IntegerType()), T.StructField("time_ms", T.LongType())])
VECTOR = T.ArrayType(T.FloatType())
_field = T.StructField

#: The columns of player states, entity frames and the fact kinds behind the envelope.
PLAYER_STATE = T.StructType([
    _field("slot", T.IntegerType()), _field("pov", T.BooleanType()), _field("pm_type", T.IntegerType()), _field("pm_flags", T.IntegerType()), _field("pm_time", T.IntegerType()), _field("gravity", T.IntegerType()),
    _field("gunindex", T.IntegerType()), _field("gunframe", T.IntegerType()), *(_field(n, VECTOR) for n in ("origin", "velocity", "view_angles", "delta_angles", "view_offset", "kick_angles")),
    _field("fov", T.FloatType()), _field("stats", T.ArrayType(T.ShortType())),
])
ENTITY = T.StructType([
    _field("number", T.IntegerType()), *(_field(n, VECTOR) for n in ("origin", "old_origin", "angles")), _field("models", T.ArrayType(T.IntegerType())), *(_field(n, T.IntegerType()) for n in ("frame", "skin", "sound", "event", "solid")),
    *(_field(n, T.LongType()) for n in ("effects", "renderfx", "morefx")), _field("loop_volume", T.FloatType()), _field("loop_attenuation", T.FloatType()),
])
ENTITY_FRAME = T.StructType([_field("frame_number", T.IntegerType()), _field("delta_frame", T.IntegerType()), _field("mvd", T.BooleanType()), _field("entities", T.ArrayType(ENTITY))])
FACTS = {
    "segment_facts": "map string, mod string, end_ms long, mode int, mode_conf int, adapter int, quality int, fingerprint string",
    "epoch": "epoch_id int, end_ms long, start_conf int, end_conf int, closed boolean, quality int, final_scoreboard boolean, result_reason int, fingerprint string",
    "track": "track_id int, slot int, end_ms long, identity_end_ms long, team int, team_conf int, active_seen boolean, spectator_seen boolean, chase_spectator boolean, combat_seen boolean, is_recorder_pov boolean, aliases array<string>",
    "participant": "epoch_id int, track_id int, active boolean, spectator boolean, score_authoritative boolean, baseline_score int, final_score int, frags_earned int, penalties int, kills int, deaths int, rank_score int, rank_conf int, rank_result int",
    "weapon_fact": "epoch_id int, track_id int, weapon string, kills int, deaths int",
    "pickup_fact": "epoch_id int, track_id int, item string, count int",
}
MAX_RECORD = 8 << 20


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, payload, kind, seq, segment, time_ms) of every line below path; the recording is its file's name."""
    raw = spark.read.text(path).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.jsonl)?$", 1).alias("recording_id"), F.col("value").alias("payload"))
    return raw.where(F.length("payload") > 0).withColumn("__e", F.from_json("payload", ENVELOPE)).select("recording_id", "payload", "__e.*")


def of_kind(records: DataFrame, kind: str, schema: T.StructType | str) -> DataFrame:
    """The records of one kind with its columns."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return records.where(F.col("kind") == kind).select("recording_id", "seq", "segment", "time_ms", F.from_json("payload", schema).alias("__r")).select("recording_id", "seq", "segment", "time_ms", "__r.*")


def demultiplex(records: DataFrame) -> dict[str, DataFrame]:
    """player_states, entity_frames, events (all other kinds with their payload) and a table for each kind of fact."""
    out = {"player_states": of_kind(records, "player_state", PLAYER_STATE), "entity_frames": of_kind(records, "entity_frame", ENTITY_FRAME)}
    out["events"] = records.where(~F.col("kind").isin("player_state", "entity_frame")).select("recording_id", "seq", "segment", "time_ms", "kind", "payload")
    return out | {k: of_kind(records, k, s) for k, s in FACTS.items()}


def status(records: DataFrame) -> DataFrame:
    """One row a recording: records, states, violations (a seq that doesn't increase in file order is seen as a
    repeated one), oversized, has_result, clean, and status: decoded if clean with a state, else rejected."""
    repeated = W.partitionBy("recording_id", "seq")
    r = records.withColumn("__again", (F.count("*").over(repeated) > 1) | F.col("seq").isNull() | F.col("kind").isNull())
    result = F.from_json("payload", "return_code int, quality int")
    good = (F.col("kind") == "decode_result") & (result["return_code"] == 0) & (result["quality"] == 0)
    out = r.groupBy("recording_id").agg(
        F.count("*").alias("records"),
        F.count(F.when(F.col("kind") == "player_state", 1)).alias("states"),
        F.count(F.when(F.col("__again"), 1)).alias("violations"),
        F.count(F.when(F.octet_length("payload") > MAX_RECORD, 1)).alias("oversized"),
        F.coalesce(F.bool_or(F.col("kind") == "decode_result"), F.lit(False)).alias("has_result"),
        F.coalesce(F.bool_or(good), F.lit(False)).alias("clean"),
        F.max_by("kind", "seq").alias("__last"),
    )
    ok = F.col("clean") & (F.col("states") > 0) & (F.col("violations") == 0) & (F.col("oversized") == 0) & (F.col("__last").endswith("_result"))
    return out.withColumn("status", F.when(ok, "decoded").otherwise("rejected")).drop("__last")


def write_lines(records: DataFrame, path: str) -> None:
    """Payloads as lines, a folder for each recording, in seq order within it."""
    records.repartition("recording_id").sortWithinPartitions("recording_id", "seq").select("recording_id", "payload").write.partitionBy("recording_id").text(path)


def carried_entities(frames: DataFrame) -> DataFrame:
    """(recording_id, segment, number, seq, time_ms, present, entity): each entity at every frame of its segment, its
    last known state carried on while it isn't mentioned. A removed one is absent, which is not dead."""
    w = W.partitionBy("recording_id", "segment", "number").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    seen = frames.select("recording_id", "segment", "seq", F.explode("entities").alias("entity"), F.col("entity.number").alias("number"))
    removed = frames.select("recording_id", "segment", "seq", F.explode("removed").alias("number")).withColumn("entity", F.lit(None).cast(seen.schema["entity"].dataType)).select("recording_id", "segment", "seq", "entity", "number")
    told = seen.withColumn("gone", F.lit(False)).unionByName(removed.withColumn("gone", F.lit(True)))
    grid = told.select("recording_id", "segment", "number").distinct().join(frames.select("recording_id", "segment", "seq", "time_ms"), ["recording_id", "segment"])
    out = grid.join(told, ["recording_id", "segment", "number", "seq"], "left").withColumn("__s", F.last(F.when(F.col("gone").isNotNull(), F.struct("gone", "entity")), ignorenulls=True).over(w))
    return out.where("__s IS NOT NULL").select("recording_id", "segment", "number", "seq", "time_ms", (~F.col("__s.gone")).alias("present"), F.when(~F.col("__s.gone"), F.col("__s.entity")).alias("entity"))
