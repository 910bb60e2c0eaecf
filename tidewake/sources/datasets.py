"""Datasets of windows as Parquet, with the checks that a reader insists on, and packages of small documents."""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import violations
from ..operators.sampling import leaks


def dataset_violations(df: DataFrame, identity: str, width: int, context: int, outputs: int, most: float = 30.0) -> DataFrame:
    """(identity, rule) for each broken rule: x is context rows of width finite numbers within bounds, y and
    y_mask have outputs entries, masks are 0 or 1, events are at most their masks, and repeated identities."""
    flat = F.flatten("x")
    fine = lambda a: F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= most))
    bits = lambda a: F.forall(a, lambda v: v.isin(0, 1))
    rules = {
        "x_shape": (F.size("x") == context) & F.forall("x", lambda r: F.size(r) == width),
        "x_finite": fine(flat),
        "y_shape": (F.size("y") == outputs) & (F.size("y_mask") == outputs),
        "masks": bits(F.col("y_mask")) & bits(F.col("event_mask")),
        "events_within_masks": F.forall(F.zip_with("events", "event_mask", lambda e, m: e <= m), lambda ok: ok),
        "split": F.col("split").isin("train", "validation", "test"),
    }
    again = df.groupBy(identity).agg(F.count("*").alias("n")).where("n > 1").select(identity, F.lit("repeated").alias("rule"))
    return violations(df, identity, rules).union(again)


def check_dataset(df: DataFrame, identity: str, width: int, context: int, outputs: int) -> DataFrame:
    """Df, or an error that names a broken rule or a group in two splits."""
    bad = dataset_violations(df, identity, width, context, outputs).first()
    if bad:
        raise ValueError(f"{bad[0]}: {bad[1]}")
    leak = leaks(df, "group", "split").first()
    if leak:
        raise ValueError(f"group {leak[0]} is in {leak[1]} splits")
    return df


def routes_violations(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(rule, n) of a navigation graph's broken rules: ids 0 to n - 1, finite places, both ends there, times in (0, 60]."""
    ids = nodes.select("id").distinct().count()
    n, top = nodes.count(), nodes.agg(F.max("id")).first()[0]
    spark = nodes.sparkSession
    bad = [("ids", int(not (ids == n and (n == 0 or top == n - 1))))]
    bad.append(("position", nodes.where(~F.coalesce((F.size("origin") == 3) & F.forall("origin", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))).count()))
    ends = nodes.select(F.col("id").alias("source"))
    bad.append(("dangling", links.join(ends, "source", "left_anti").count() + links.join(ends.withColumnRenamed("source", "target"), "target", "left_anti").count()))
    bad.append(("seconds", links.where(~F.coalesce((F.col("seconds") > 0) & (F.col("seconds") <= 60), F.lit(False))).count()))
    return spark.createDataFrame([x for x in bad if x[1]], "rule string, n long")


def tree_violations(nodes: list[dict], features: int, deepest: int = 16) -> list[str]:
    """V6: what is wrong with a decision tree given as nodes (feature, threshold, left, right, value): at most 2,047 nodes,
    children in range, no node twice on a way, depth within bounds, all reached."""
    bad, seen, ways = [], set(), [(0, 0, frozenset())]
    if not 0 < len(nodes) <= 2047:
        return ["size"]
    while ways:
        i, depth, above = ways.pop()
        if depth > deepest or not 0 <= i < len(nodes) or i in above:
            bad.append("graph")
            continue
        seen.add(i)
        if nodes[i]["feature"] >= 0:
            if nodes[i]["feature"] >= features:
                bad.append("feature")
            ways += [(nodes[i][c], depth + 1, above | {i}) for c in ("left", "right")]
    return sorted(set(bad + (["unreachable"] if len(seen) != len(nodes) else [])))


def tree_column(nodes: list[dict], features: str, i: int = 0):
    """A tree's value as one nested CASE over an array column of floats: left where x <= threshold, in single precision."""
    n = nodes[i]
    if n["feature"] < 0:
        return F.lit(float(n["value"]))
    x = F.get(F.col(features), n["feature"]).cast("float")
    return F.when(x <= F.lit(float(n["threshold"])).cast("float"), tree_column(nodes, features, n["left"])).otherwise(tree_column(nodes, features, n["right"]))


def overlay(base: DataFrame, delta: DataFrame, name: str, values: str) -> DataFrame:
    """Base + delta tensor by tensor; names and sizes must agree."""
    b, d = base.select(name, F.col(values).alias("__b")), delta.select(name, F.col(values).alias("__d"))
    met = b.join(d, name, "full_outer")
    wrong = met.where(F.col("__b").isNull() | F.col("__d").isNull() | (F.size("__b") != F.size("__d"))).first()
    if wrong:
        raise ValueError(f"tensor {wrong[0]} doesn't fit")
    return met.select(name, F.zip_with("__b", "__d", lambda x, y: x + y).alias(values))


def write_package(path: str, documents: dict[str, dict], about: dict) -> None:
    """A zip of JSON documents with a manifest of their digests; the manifest says that nothing is qualified for play."""
    blobs = {n: json.dumps(d, sort_keys=True, separators=(",", ":"), allow_nan=False).encode() for n, d in documents.items()}
    manifest = about | {"runtime_qualified": False, "files": {n: hashlib.sha256(b).hexdigest() for n, b in blobs.items()}}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for n, b in sorted(blobs.items()):
            z.writestr(n, b)
        z.writestr("manifest.json", json.dumps(manifest, sort_keys=True))


def read_package(path: str, members: Sequence[str], most: int = 32 << 20) -> tuple[dict, dict[str, dict]]:
    """(manifest, documents) of a package that has exactly these members, within bounds and as digested."""
    with zipfile.ZipFile(path) as z:
        names = z.namelist()
        if sorted(names) != sorted([*members, "manifest.json"]) or sum(i.file_size for i in z.infolist()) > most:
            raise ValueError("unexpected members or size")
        blobs = {n: z.read(n) for n in names}
    manifest = json.loads(blobs.pop("manifest.json"))
    if manifest.get("runtime_qualified") is not False or set(manifest.get("files", {})) != set(members):
        raise ValueError("unsupported package")
    for n, b in blobs.items():
        if hashlib.sha256(b).hexdigest() != manifest["files"][n]:
            raise ValueError(f"{n} is damaged")
    return manifest, {n: json.loads(b) for n, b in blobs.items()}
