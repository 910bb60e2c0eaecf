"""Versioned outputs: manifests, revisions, the pointer to the current one, and upserts. Small driver-side work around Spark tables."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]{0,79}")
POINTER = "_current.json"


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage in the shared folder (see shared_folder)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def publish_json(path: str, value) -> None:
    """Writes JSON beside its place, synchronises and renames: readers see the old file or the new one, never a part."""
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".new")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, sort_keys=True, separators=(",", ":"), allow_nan=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)


def file_sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def manifest(folder: str) -> dict:
    """Bytes and sha256 of every data file of a folder."""
    out = {}
    for top, _, names in os.walk(folder):
        for n in sorted(names):
            if not n.startswith((".", "_")) or n == "_SUCCESS":
                p = os.path.join(top, n)
                out[os.path.relpath(p, folder)] = {"bytes": os.path.getsize(p), "sha256": file_sha256(p)}
    return out


def verify(folder: str, expected: dict) -> list[str]:
    """What doesn't match a manifest: missing, foreign and changed files."""
    now = manifest(folder)
    return sorted([f"missing {k}" for k in expected.keys() - now.keys()] + [f"foreign {k}" for k in now.keys() - expected.keys()] + [f"changed {k}" for k in now.keys() & expected.keys() if now[k] != expected[k]])


def revision_id(version: str, inputs: Sequence[str]) -> str:
    """A digest of the operator's declared version and its inputs' digests."""
    return hashlib.sha256("\n".join([version, *sorted(inputs)]).encode()).hexdigest()


class Catalog:
    """Immutable revisions under root and a pointer to the accepted one."""

    def __init__(self, root: str):
        self.root = root
        os.makedirs(root, exist_ok=True)

    def write(self, df: DataFrame, name: str, version: str, inputs: Sequence[str] = (), accept: bool = True) -> str:
        """Writes a revision of df (zstd Parquet) with its manifest and makes it current if accepted. Names are not reused."""
        if not NAME.fullmatch(name):
            raise ValueError(f"not a revision name: {name!r}")
        folder = os.path.join(self.root, name)
        if os.path.exists(folder):
            raise FileExistsError(folder)
        df.write.option("compression", "zstd").parquet(os.path.join(folder, "data"))
        publish_json(os.path.join(folder, "manifest.json"), {"version": version, "inputs": sorted(inputs), "accepted": accept, "files": manifest(os.path.join(folder, "data"))})
        if accept:
            self.point(name)
        return folder

    def describe(self, name: str) -> dict:
        with open(os.path.join(self.root, name, "manifest.json"), encoding="utf-8") as f:
            return json.load(f)

    def current(self) -> str | None:
        try:
            with open(os.path.join(self.root, POINTER), encoding="utf-8") as f:
                name = json.load(f)["name"]
        except FileNotFoundError:
            return None
        if not NAME.fullmatch(name):
            raise ValueError(f"not a revision name: {name!r}")
        return name

    def point(self, name: str) -> None:
        """C14: makes an accepted revision current; also the way back to an older one."""
        if not self.describe(name)["accepted"]:
            raise ValueError(f"{name} was not accepted")
        publish_json(os.path.join(self.root, POINTER), {"name": name})

    def read(self, spark: SparkSession, version: str, name: str | None = None) -> DataFrame:
        """A revision (the current one) as a DataFrame, if its declared version and every file's digest are as expected."""
        name = name or self.current()
        if name is None:
            raise FileNotFoundError("no current revision")
        d = self.describe(name)
        if d["version"] != version:
            raise ValueError(f"{name} has version {d['version']}, not {version}: import it again")
        if bad := verify(os.path.join(self.root, name, "data"), d["files"]):
            raise ValueError(f"{name} is damaged: {bad[0]}")
        return spark.read.parquet(os.path.join(self.root, name, "data"))


def upsert(table: DataFrame, changes: DataFrame, on: Sequence[str]) -> DataFrame:
    """Table with its rows of the changes' keys replaced and new ones added; changes has one row a key."""
    return table.join(changes.select(*on), list(on), "left_anti").unionByName(changes)


class WriterLock:
    """One writer a folder; a second one fails at once. The file goes when the writer is done."""

    def __init__(self, root: str):
        self.path = os.path.join(root, "_writer.lock")
        self.token = uuid.uuid4().hex

    def __enter__(self):
        fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        os.write(fd, self.token.encode())
        os.close(fd)
        return self

    def __exit__(self, *exc):
        with open(self.path) as f:
            mine = f.read() == self.token
        if mine:
            os.unlink(self.path)


def issues(df: DataFrame, path: str, message: str, most: int = 2000) -> DataFrame:
    """C11: (path, message) of rows with an error, messages cut to so many characters."""
    return df.where(F.col(message).isNotNull()).select(F.col(path).alias("path"), F.substring(message, 1, most).alias("message"))
