"""Queries that run a stream to its end over the driver's events, and the record stream, with their DuckDB counterparts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import records
from ..streaming import lives
from .tables import HOURS6, ms

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _finished(spark, df):
    """The rows of a stream that has read everything there is, by way of the shared folder."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = lives.ingest(df, f"{path}/out", f"{path}/checkpoint")
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def _events(spark, sf):
    return lives.watch(spark, f"{sf}/events*.parquet", SCHEMA)


@query("""WITH l AS (SELECT user_id, ts, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), i AS (SELECT *, SUM(CASE WHEN p IS NULL OR ts >= p + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL 6 HOUR AS "end", COUNT(*) AS n FROM i GROUP BY user_id, s HAVING MAX(ts) + INTERVAL 6 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, sf):
    """Sessions that the watermark has closed."""
    s = _events(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    out = _finished(spark, lives.sessions(s, "user_id", "at"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query(f"""WITH f AS (SELECT user_id AS rec, event_id AS seq, epoch_us(ts) // 1000 AS t, event_type = 'error' AS dead FROM events)
, l AS (SELECT *, LAG(t) OVER w AS pt, LAG(dead) OVER w AS pd, LEAD(t) OVER w AS nt, LEAD(dead) OVER w AS nd FROM f WINDOW w AS (PARTITION BY rec ORDER BY seq))
, i AS (SELECT *, SUM(CASE WHEN pt IS NULL OR pd OR t - pt > {HOURS6} THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY seq ROWS UNBOUNDED PRECEDING) AS life FROM l WHERE NOT dead)
, g AS (SELECT rec, life, MIN(t) AS first_ms, MAX(t) AS last_ms, COUNT(*) AS n, arg_max(nt, seq) AS nt, arg_max(nd, seq) AS nd, COUNT(nt) = COUNT(*) AS has FROM i GROUP BY rec, life)
SELECT rec, CAST(life AS BIGINT) AS life, first_ms, CASE WHEN nt - last_ms <= {HOURS6} AND nd THEN nt ELSE last_ms END AS last_ms, n + CASE WHEN nt - last_ms <= {HOURS6} AND nd THEN 1 ELSE 0 END AS n, CASE WHEN nt - last_ms <= {HOURS6} AND nd THEN 'death' ELSE 'gap' END AS ended FROM g WHERE has""")
def stream_lives(spark, sf):
    """R2: lives that a death or a gap has ended, from keyed state."""
    s = _events(spark, sf).select(F.col("user_id").alias("rec"), F.col("event_id").alias("seq"), ms("ts").alias("time_ms"), F.when(F.col("event_type") == "error", 0).otherwise(50).cast("long").alias("health"))
    return _finished(spark, lives.lives(s, HOURS6))


@query("""WITH r AS (SELECT user_id, event_id, event_type FROM events)
SELECT 'rec' || user_id AS recording_id, COUNT(*) AS records, COUNT(CASE WHEN event_type = 'view' THEN 1 END) AS states, COALESCE(arg_max(event_type, event_id) = 'signup', FALSE) AND COUNT(CASE WHEN event_type = 'view' THEN 1 END) > 0 AS decoded FROM r GROUP BY user_id""")
def record_status(spark, sf):
    """Records as JSON lines, read back by kind and judged; a recording whose last record is a clean result is decoded."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    kind = F.when(F.col("event_type") == "view", "player_state").when(F.col("event_type") == "signup", "decode_result").otherwise("print")
    body = F.struct(kind.alias("kind"), F.col("event_id").alias("seq"), F.lit(0).alias("segment"), ms("ts").alias("time_ms"), F.lit(0).alias("return_code"), F.lit(0).alias("quality"))
    raw = e.select(F.concat(F.lit("rec"), F.col("user_id").cast("string")).alias("recording_id"), F.to_json(body).alias("payload"))
    r = raw.withColumn("__e", F.from_json("payload", records.ENVELOPE)).select("recording_id", "payload", "__e.*")
    return records.status(r).select("recording_id", "records", "states", (F.col("status") == "decoded").alias("decoded"))


@query("SELECT event_type, COUNT(*) AS n, MIN(event_id) AS first_id FROM events WHERE value > 100 GROUP BY 1")
def projected_scan(spark, sf):
    """A pruned, filtered scan."""
    return spark.read.parquet(f"{sf}/events.parquet").where("value > 100").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""WITH f AS (SELECT user_id AS rec, event_id AS came, event_id - CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 = 0 THEN 500 ELSE 0 END AS seq, epoch_us(ts) // 1000 AS t FROM events)
SELECT rec, t AS time_ms FROM (SELECT *, GREATEST(COALESCE(MAX(seq) OVER (PARTITION BY rec ORDER BY came ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), -1) AS top FROM f) m WHERE seq <= top""")
def stream_late(spark, sf):
    """Rows whose number doesn't increase in the order of arrival: told, not dropped."""
    k = F.get_json_object("props", "$.k").cast("long")
    s = _events(spark, sf).select(
        F.col("user_id").alias("rec"), (F.col("event_id") - F.when(k % 10 == 0, 500).otherwise(0)).alias("seq"), ms("ts").alias("time_ms"), F.lit(50).cast("long").alias("health"), F.col("event_id").alias("came")
    )
    return _finished(spark, lives.lives(s, HOURS6, "came")).where("ended = 'late'").select("rec", F.col("first_ms").alias("time_ms"))
