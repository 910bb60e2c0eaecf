"""Recordings in folders and archives: listings, bounded extraction and content identity, on the executors."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDINGS, ARCHIVES = (".dm2", ".mvd2"), (".zip", ".rar")


@dataclass(frozen=True)
class Limits:
    """Bounds of one archive's traversal."""

    depth: int = 4
    member_bytes: int = 512 << 20
    expanded_bytes: int = 4 << 30
    members: int = 100_000


def listing(spark: SparkSession, path: str, suffixes: Sequence[str] = RECORDINGS + ARCHIVES) -> DataFrame:
    """(path, modified, bytes) of the files below path with these suffixes; nothing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    return files.where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))


def unstable(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose size or time differs between two listings, or that only one of them has: to be tried again."""
    b = after.select("path", F.col("modified").alias("m"), F.col("bytes").alias("b"))
    same = before.join(b, "path", "full_outer")
    return same.where(~(F.col("modified").eqNullSafe(F.col("m")) & F.col("bytes").eqNullSafe(F.col("b")))).select("path")


def _suffix(name: str) -> str:
    dot = name.rfind(".")
    return name[dot:].lower() if dot >= 0 else ""


def members(address: str, content: bytes, suffix: str, limits: Limits, extract: bool, depth: int = 0, budget: list | None = None):
    """(address, name, bytes, content or None, error) of the recordings in a file, archives within archives included.

    An address is the container's with !{"index":i,"name":n}; a member's name never becomes a path. An error concerns
    its own member and leaves the others alone.
    """
    budget = budget if budget is not None else [limits.expanded_bytes, limits.members]
    if suffix in RECORDINGS:
        yield address, address, len(content), content if extract else None, None
        return
    if suffix not in ARCHIVES:
        return
    if depth >= limits.depth:
        yield address, address, len(content), None, "nested too deep"
        return
    if suffix == ".rar":
        yield address, address, len(content), None, "rar archives can't be opened here"
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        entries = archive.infolist()
    except (zipfile.BadZipFile, ValueError, OSError) as e:
        yield address, address, len(content), None, f"{type(e).__name__}: {e}"[:2000]
        return
    if len(entries) > limits.members:
        yield address, address, len(content), None, "too many members"
        return
    for index, entry in enumerate(entries):
        kind = _suffix(entry.filename)
        if entry.is_dir() or kind not in RECORDINGS + ARCHIVES:
            continue
        child = f"{address}!{json.dumps({'index': index, 'name': entry.filename}, sort_keys=True, separators=(',', ':'))}"
        try:
            budget[1] -= 1
            if budget[1] < 0:
                raise ValueError("too many members")
            if entry.file_size > limits.member_bytes:
                raise ValueError("member is too large")
            if kind in RECORDINGS and not extract:
                yield child, entry.filename, entry.file_size, None, None
                continue
            with archive.open(entry) as f:
                data = f.read(limits.member_bytes + 1)  # what is declared need not be true
            budget[0] -= len(data)
            if len(data) != entry.file_size or len(data) > limits.member_bytes:
                raise ValueError("member isn't as large as declared")
            if budget[0] < 0:
                raise ValueError("archive expands too far")
        except Exception as e:  # noqa: BLE001  any damage is this member's own
            yield child, entry.filename, entry.file_size, None, f"{type(e).__name__}: {e}"[:2000]
            continue
        if kind in RECORDINGS:
            yield child, entry.filename, len(data), data, None
        else:
            yield from members(child, data, kind, limits, extract, depth + 1, budget)


def recordings(spark: SparkSession, path: str, limits: Limits = Limits(), extract: bool = True) -> DataFrame:
    """(path, address, name, bytes, content, content_sha, error) of all recordings below path, a file a row at a time.

    extract=False lists members without expanding them (S3).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(dm2|mvd2|zip|rar)$"))
    return expanded(files, limits, extract)


def expanded(files: DataFrame, limits: Limits = Limits(), extract: bool = True) -> DataFrame:
    """recordings() of rows (path, content)."""

    def run(batches):
        import hashlib

        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"]):
                rows = [(p, *m) for m in members(p, bytes(data), _suffix(p), limits, extract)]
                out = pd.DataFrame(rows, columns=["path", "address", "name", "bytes", "content", "error"])
                out["content_sha"] = out["content"].map(lambda c: None if c is None else hashlib.sha256(c).hexdigest())
                yield out

    return files.select("path", "content").mapInPandas(run, "path string, address string, name string, bytes long, content binary, error string, content_sha string")


def with_map_hint(rows: DataFrame, hint: str) -> DataFrame:
    """S3: whether a name contains the hint, whatever the case: a hint only."""
    return rows.withColumn("map_name_hint", F.lower("name").contains(hint.lower()))


def recording_id(content_sha, version: str):
    """The id of a content under a version of the pipeline."""
    return F.sha2(F.concat_ws(":", content_sha, F.lit(version)), 256)
