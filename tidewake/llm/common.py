"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: str.translate table that lower-cases A-Z only.
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def let(value: Column, f) -> Column:
    """f(value), with value worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if its files make fewer tasks than there are cores, as a small table of one file does; else df itself."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local one if all runs on one machine (tests); a cluster must name one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewake-"))
    return sc.getCheckpointDir()


#: Folders that keep() has written; results may still read them, so they go when the driver ends.
_KEPT: list = []


@atexit.register
def clean() -> None:
    """Deletes what keep() has written so far; frames that read it can't be used afterwards."""
    while _KEPT:
        spark, path = _KEPT.pop()
        with contextlib.suppress(Exception):  # the JVM may have ended first
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df with a reliable checkpoint, so that lost executors cost a reread and not the whole lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Like cut(), as a compressed Parquet table in the shared folder: for wide rows that are read more than once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewake-{uuid.uuid4().hex}"
    _KEPT.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch: what a worker holds at once follows from it, and its allocators don't give memory back.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20
#: A list of ids up to this many bytes is broadcast.
BROADCAST_BYTES = 64 << 20


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """docs without the rows whose column is in ids (one column; a null there stands for null). The list's size is measured:
    up to BROADCAST_BYTES it goes to the documents, beyond that both are shuffled."""
    name = "__without"
    ids = cut(ids.toDF(name).distinct())
    width = 96 if ids.schema[name].dataType.typeName() == "string" else 32  # a sha256 in hex, or a number
    small = ids.count() * width <= BROADCAST_BYTES
    return docs.join(F.broadcast(ids) if small else ids, docs[column].eqNullSafe(ids[name]), "left_anti")


def bounded_batches(spark: SparkSession) -> None:
    """Python workers get at most BATCH_ROWS rows and about BATCH_BYTES bytes at once (or one row), unless the session asks for less.

    Plans read the settings when they run, so they are lowered for the session and stay so.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points in one uint32 array, and the offsets (one more than texts) of each."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum(lens)])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(texts: list[str], most: int = 4_000_000) -> list[tuple[int, int]]:
    """Ranges of texts with at most so many code points each (a longer text gets a range of its own)."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            out.append((start, i))
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        out.append((start, len(texts)))
    return out
