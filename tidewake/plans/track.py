"""Frames of play made from the events table by rule, so that trajectory operators have an oracle on the driver's data.

A user is a recording; its events in order are frames 100 ms apart, with a gap of 900 ms more at every thirteenth value
of k. Positions, velocities, health and labels are integer arithmetic on event_id and k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BODY = """
SELECT rec, seq, CAST(rn * 100 + gap * 900 AS BIGINT) AS time_ms,
       CAST(sx AS DOUBLE) AS x, CAST((seq * 7) % 40 AS DOUBLE) AS y, CAST((k % 5) * 30 AS DOUBLE) AS z,
       CAST((k % 9) * 80 - 160 AS DOUBLE) AS vx, CAST(((seq * 7) % 11 - 5) * 30 AS DOUBLE) AS vy, CAST((k % 7 - 3) * 60 AS DOUBLE) AS vz,
       CAST((seq * 37) % 360 - 180 AS DOUBLE) AS yaw, CAST((seq * 11) % 120 - 60 AS DOUBLE) AS pitch,
       CASE WHEN event_type = 'error' AND k < 50 THEN 0 ELSE 40 + k END AS health, (seq * 5) % 120 AS armor,
       (CASE WHEN k % 3 = 0 THEN 4 ELSE 0 END) + (CASE WHEN k % 29 = 0 THEN 32 ELSE 0 END) AS flags,
       k % 6 AS label, k, event_type, value, ts
FROM (SELECT user_id AS rec, event_id AS seq, k, event_type, value, ts,
             ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
             SUM(CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gap,
             SUM((k % 9) * 6) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sx
      FROM (SELECT *, {k} AS k FROM {events}) e) f
"""

#: The frames as a DuckDB common table expression named t, to be followed by a query.
CTE = "WITH RECURSIVE t AS (" + _BODY.format(k="CAST(json_extract_string(props, '$.k') AS BIGINT)", events="events") + ")"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames; one shuffle on the user, which window operators by rec reuse."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(_BODY.format(k="CAST(get_json_object(props, '$.k') AS BIGINT)", events="{events}"), events=events)


GROUNDED = "(flags // 4) % 2 = 1"
HELD = "(flags // 32) % 2 = 1"
