"""Streams of frames: idempotent file ingestion, sessions, lives that end with a death or a gap, and late rows that are told."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

LIFE = "rec long, life long, first_ms long, last_ms long, n long, ended string"
STATE = "life long, first_ms long, last_ms long, n long, last_seq long"


def watch(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """The Parquet files of a folder as a stream; each file is read once, however often the folder is looked at."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends a stream to a Parquet folder; once for what is there, or every so often. A restart goes on where it was."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def sessions(stream: DataFrame, key: str, ts: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Rows and bounds of sessions that a static gap ends; rows later than the watermark are left out by Spark."""
    by = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    return by.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _life(gap_ms: int, arrival: str):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        life, first, last, n, seq = state.get if state.exists else (0, 0, 0, 0, -1)
        out = []
        rows = pd.concat(list(batches)).sort_values(arrival, kind="stable")
        for s, t, health in zip(rows["seq"], rows["time_ms"], rows["health"]):
            if s <= seq:
                out.append((key[0], life, t, t, 1, "late"))
                continue
            if n and t - last > gap_ms:
                out.append((key[0], life, first, last, n, "gap"))
                n = 0
            if health <= 0:
                if n:
                    out.append((key[0], life, first, t, n + 1, "death"))
                    n = 0
            else:
                if n == 0:
                    life, first = life + 1, t
                n += 1
            last, seq = t, s
        state.update((int(life), int(first), int(last), int(n), int(seq)))
        yield pd.DataFrame(out, columns=["rec", "life", "first_ms", "last_ms", "n", "ended"])

    return run


def lives(stream: DataFrame, gap_ms: int = 250, arrival: str = "seq") -> DataFrame:
    """A row per life that has ended (rec, life, first_ms, last_ms, n, ended: death or gap), from rows with rec, seq,
    time_ms and health. Open lives wait in the state. A row whose seq doesn't increase becomes a row "late" of its own:
    it is rejected, not silently dropped. Rows of a micro-batch are taken in the order of arrival, a column that says how they
    came (an offset): then what is late doesn't depend on how rows fall into batches. Without one (seq) their order is restored
    within a batch, and only rows of later batches can be late. A task holds a key's rows of one micro-batch, which
    files_per_batch bounds; state is five numbers a key."""
    rows = stream.select("rec", "seq", "time_ms", "health", *([arrival] if arrival != "seq" else []))
    return rows.groupBy("rec").applyInPandasWithState(_life(gap_ms, arrival), LIFE, STATE, "append", "NoTimeout")


def run_until(query: StreamingQuery, cancelled: Callable[[], bool], every: float = 1.0) -> str:
    """Waits for a query's end and asks every so many seconds whether it is cancelled; then it is stopped between two
    micro-batches' commits, so a restart goes on where it was. completed or cancelled; a query that fails raises."""
    while not query.awaitTermination(every):
        if cancelled():
            query.stop()
            return "cancelled"
    return "completed"


class Progress(StreamingQueryListener):
    """A numbered log of a session's stream events, and a way to ask whether one has ended."""

    def __init__(self):
        self.events: list[dict] = []

    def _add(self, kind: str, **more) -> None:
        self.events.append({"seq": len(self.events), "kind": kind, **more})

    def onQueryStarted(self, event) -> None:
        self._add("started", id=str(event.id))

    def onQueryProgress(self, event) -> None:
        self._add("progress", id=str(event.progress.id), rows=event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add("failed" if event.exception else "completed", id=str(event.id))
