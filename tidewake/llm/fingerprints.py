"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if its least s-mer (by hash) is its first or its last one. Whether it
is depends on its own characters alone, so equal passages give equal anchors wherever they stand. A document's
fingerprint keeps the least anchor hash in each of BINS bins, one byte each, and the order in which these anchors
stand in the text, another byte each. Two texts are matched by position: of the bins that are equal, those count
that stand in the same order in both (the longest chain of them); their share of the filled bins estimates how much of
their anchors the texts have in common, in the same order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded_batches, code_points, cut, mix, slices

K, S, BINS = 16, 8, 128
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: About so many documents make a range of ids, however many ranges that gives; a range is streamed, never held.
RANGE_ROWS = 4096
#: Ids that are looked at for each bound between ranges (any bounds give the same result).
LOOKED_AT = 4
#: Longer texts are read in pieces of so many code points that overlap by K - 1, so that memory stays bounded.
PIECE = 1 << 20


def _smers(flat: np.ndarray) -> np.ndarray:
    """Hash of the S code points from each position (S a power of two), by doubling."""
    h = mix(flat.astype(np.uint64) + _STEP)
    size = 1
    while size < S:
        h = h[:-size] * _STEP + (h[size:] ^ (h[size:] >> np.uint64(29))) if len(h) > size else h[:0]
        size *= 2
    return mix(h)


def anchors(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of all closed syncmers, by text and position.

    A text of fewer than K code points, but not none, has one anchor: itself, at 0.
    """
    flat, offs = code_points(texts)
    lens = np.diff(offs)
    hs = _smers(flat)
    w = K - S + 1
    doc, pos, val = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(hs) >= w:
        low, size = hs, 1
        while size * 2 <= w:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < w:
            low = np.minimum(low[: len(low) - (w - size)], low[w - size :])
        first, last = hs[: len(low)], hs[w - 1 :]
        at = np.flatnonzero((low == first) | (low == last))
        doc = np.searchsorted(offs, at, "right") - 1
        inside = at + K <= offs[doc + 1]
        at, doc = at[inside], doc[inside]
        # A k-mer is its first and last s-mer together when K = 2 S.
        val = mix(first[at] * _STEP + hs[at + K - S])
        pos = at - offs[doc]
    short = np.flatnonzero((lens > 0) & (lens < K))
    if len(short):
        whole = np.array([int.from_bytes(hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for i in short], np.uint64)
        doc, pos, val = np.concatenate([doc, short]), np.concatenate([pos, np.zeros(len(short), np.int64)]), np.concatenate([val, whole])
        order = np.lexsort((pos, doc))
        doc, pos, val = doc[order], pos[order], val[order]
    return doc, pos, val


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text number, offset, piece): texts whole, but long ones in overlapping pieces that hold each of their k-mers once."""
    doc, at, out = [], [], []
    for i, t in enumerate(texts):
        for j in range(0, max(1, len(t) - K + 1), PIECE):
            doc.append(i)
            at.append(j)
            out.append(t if len(t) <= PIECE else t[j : j + PIECE + K - 1])
    return np.array(doc, np.int64), np.array(at, np.int64), out


def sketches(texts: list[str]) -> np.ndarray:
    """A row of 2 * BINS bytes for each text: its anchors' hashes by bin (0: no anchor falls into the bin), and their places in the text's order."""
    none = np.iinfo(np.uint64).max
    least = np.full(len(texts) * BINS, none, np.uint64)
    place = np.zeros(len(texts) * BINS, np.int64)
    for doc, pos, val in _found(texts):
        slot = doc * BINS + (val >> np.uint64(57)).astype(np.int64)
        val = val & np.uint64(2**57 - 1)
        order = np.lexsort((pos, val, slot))
        head = order[np.flatnonzero(np.diff(slot[order], prepend=-1))]  # the least of each bin, where it stands first
        better = head[val[head] < least[slot[head]]]
        least[slot[better]], place[slot[better]] = val[better], pos[better]
    hashes = np.where(least == none, 0, (mix(least) % np.uint64(255)).astype(np.uint8) + np.uint8(1)).astype(np.uint8).reshape(len(texts), BINS)
    place = np.where(least == none, -1, place).reshape(len(texts), BINS)
    rank = np.argsort(np.argsort(place, axis=1, kind="stable"), axis=1).astype(np.uint8)
    return np.hstack([hashes, np.where(hashes > 0, rank, 0).astype(np.uint8)])


def _chain(x: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    tails: list[int] = []
    for v in x.tolist():
        k = bisect_left(tails, v)
        tails[k : k + 1] = [v]
    return len(tails)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By row: of the bins that either row fills, the share that are equal and stand in the same order in both; 1 if both are empty."""
    a, in_a, b, in_b = a[:, :BINS], a[:, BINS:], b[:, :BINS], b[:, BINS:]
    filled = ((a > 0) | (b > 0)).sum(1)
    same = (a == b) & (a > 0)
    chained = np.zeros(len(a))
    for i in np.flatnonzero(same.any(1)):
        x, y = in_a[i, same[i]], in_b[i, same[i]]
        chained[i] = len(x) if (x == y).all() else _chain(y[np.argsort(x)])
    return np.where(filled == 0, 1.0, chained / np.maximum(filled, 1))


def fingerprint(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (lowercase hex of its 2 * BINS bytes), n_anchors. Null text counts as empty: all bins empty."""

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].fillna("").tolist()
            n = np.zeros(len(texts), np.int64)
            for doc, _, _ in _found(texts):
                n += np.bincount(doc, minlength=len(texts))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fingerprint": [r.tobytes().hex() for r in sketches(texts)], "n_anchors": n})

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fingerprint string, n_anchors long")


def _found(texts: list[str]):
    """(text number, position, hash) of the texts' anchors, in bounded parts."""
    of, at, parts = pieces(texts)
    for a, b in slices(parts, PIECE):
        doc, pos, val = anchors(parts[a:b])
        yield of[a + doc], at[a + doc] + pos, val


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, at, anchor): every closed syncmer of every text, for positional matching. Null and empty texts have none."""

    def run(batches):
        for pdf in batches:
            ids = pdf["doc_id"].astype("Int64").array
            for doc, pos, val in _found(pdf["text"].fillna("").tolist()):
                yield pd.DataFrame({"doc_id": ids[doc], "at": pos, "anchor": val.view(np.int64)})

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, at long, anchor long")


def _key() -> list:
    """What documents are ordered by, descending: whether the id is known, the id, and a hash of the text for equal ids."""
    return [F.col("doc_id").isNotNull().cast("long").alias("known"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("h")]


def _bounds(docs: DataFrame) -> np.ndarray:
    """Rows (known, id, h), ascending: keys that cut docs into ranges of about RANGE_ROWS rows.

    They are taken from a sample by hash, of which a few rows a range reach the driver (24 bytes each): any bounds give the same result.
    """
    n = docs.count() // RANGE_ROWS
    if n < 1:
        return np.empty((0, 3), np.int64)
    share = F.pmod(F.xxhash64("known", "id", "h"), F.lit(1 << 30)) <= F.lit((1 << 30) * LOOKED_AT // RANGE_ROWS)
    some = docs.select(*_key()).where(share).distinct().toPandas().to_numpy(np.int64).reshape(-1, 3)
    some = some[np.lexsort((some[:, 2], some[:, 1], some[:, 0]))]
    return some[np.unique(np.linspace(0, len(some), n + 1).astype(int)[1:-1])] if len(some) else some


def _sortable(x: np.ndarray) -> np.ndarray:
    """Rows of three numbers as strings of 24 bytes that sort as the rows do."""
    return (np.ascontiguousarray(x, np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view("S24").reshape(len(x))


def _range_of(bounds: np.ndarray):
    """Column function: the number of the range of (known, id, h); range 0 has the largest keys."""
    cuts = _sortable(bounds)

    def number(known: pd.Series, id_: pd.Series, h: pd.Series) -> pd.Series:
        x = _sortable(np.stack([known, id_, h], 1))
        return pd.Series(len(cuts) - np.searchsorted(cuts, x, "right")).astype(np.int64)

    return F.pandas_udf(number, "long")


def against_next(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one that follows in descending doc_id, null ids last, equal ids by descending
    hash of the text; after the last comes the first, and a single row is its own next one. The edited text ends in the
    next text's first floor(n/2) code points (or all of it) in place of its own last floor(n/2). Null texts
    count as empty; equal texts get equal fingerprints; repeated rows stay separate rows; an empty table gives none.
    Very long texts are read whole, in pieces. Other columns are ignored, whatever their names.

    Every text is shuffled once, to a range of keys of about RANGE_ROWS rows; one row of the key at the head of a range
    is also sent to the range before it, so no task needs another's rows. Bounds cut equal and null ids by their texts' hashes,
    so only rows that are equal in id and text share a range however many they are, and those are streamed.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.select("doc_id", "text", *_key())
    number = _range_of(_bounds(keyed))
    parts = keyed.withColumn("part", number("known", "id", "h"))
    # The head of each range: its largest key, as one row of that key with the number of the range before it.
    heads = cut(parts.groupBy("part").agg(F.max(F.struct("known", "id", "h")).alias("k")))
    before = Window.partitionBy("block").orderBy("part")
    # Numbers of ranges in a row, without gathering them: the last of each thousand is handed to the next.
    block = heads.withColumn("block", F.expr("part div 1000"))
    last = block.groupBy("block").agg(F.max("part").alias("end")).withColumn("all", F.lit(0))
    last = last.select("block", F.coalesce(F.lag("end").over(Window.partitionBy("all").orderBy("block")), F.max("end").over(Window.partitionBy("all"))).alias("earlier"))
    target = block.join(last, "block").select("k.*", F.coalesce(F.lag("part").over(before), "earlier").alias("to"))
    mine = ["known", "id", "h"]
    target = F.broadcast(target) if heads.count() * 64 <= BROADCAST_BYTES else target
    copies = keyed.join(target, mine).dropDuplicates(mine).select(F.col("to").alias("part"), F.lit(True).alias("copy"), "doc_id", "h", "text")
    dealt = parts.select("part", F.lit(False).alias("copy"), "doc_id", "h", "text").unionByName(copies)
    dealt = dealt.repartition("part").sortWithinPartitions("part", "copy", F.desc_nulls_last("doc_id"), F.desc("h"))
    return dealt.drop("h").mapInPandas(_edit, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _edit(batches):
    """Batches come by range, its rows in order, then copies of the rows of the next range's head. Holds one range's last row between batches."""
    wait: list = []  # rows of the current range that have no next one yet: (id, text), one at most
    now = None
    done = False  # the current range has got its copy

    def close(rows):
        out, rows[:] = rows[:], []
        return out

    def result(rows):  # rows: (id, text, next text)
        texts, nexts = [r[1] for r in rows], [r[2] for r in rows]
        half = [len(t) // 2 for t in texts]
        edited = [t[: len(t) - h] + x[:h] for t, x, h in zip(texts, nexts, half)]
        n = len(rows)
        apart = [i for i in range(n) if i + 1 == n or nexts[i] is not texts[i + 1]]  # whose next row isn't the next one here
        sk = sketches(texts + edited + [nexts[i] for i in apart])
        own, ed = sk[:n], sk[n : 2 * n]
        follow = np.vstack([own[1:], own[:1]])
        follow[apart] = sk[2 * n :]
        return pd.DataFrame({
            "doc_id": pd.array([r[0] for r in rows], dtype="Int64"),
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited],
            "fingerprint": [x.tobytes().hex() for x in own],
            "edited_fingerprint": [x.tobytes().hex() for x in ed],
            "near_edited": likeness(own, ed),
            "near_next": likeness(own, follow),
        })

    for pdf in batches:
        rows = []
        for part, copy, i, text in zip(pdf["part"], pdf["copy"], pdf["doc_id"], pdf["text"]):
            if part != now:
                now, done = part, False
            if copy:
                if wait and not done:
                    rows.append((*close(wait)[0], text))
                done = True
                continue
            if wait:
                rows.append((*close(wait)[0], text))
            wait.append((None if pd.isna(i) else int(i), text))
        if rows:
            yield result(rows)
