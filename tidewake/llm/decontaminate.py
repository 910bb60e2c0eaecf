"""Benchmark decontamination: a hash set of test n-grams against every window of every document. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_lower, cut, let, without

#: What separates words, after A-Z are lower-cased: ASCII other than digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK, -1), lambda w: w != "")


def _grams(hashes: Column, n: int) -> Column:
    """Hashes of all runs of n elements, by position; none if there are fewer."""
    whole = lambda h: F.filter(F.sequence(F.lit(0), F.size(h)), lambda i: i + n <= F.size(h))
    return let(hashes, lambda h: F.transform(whole(h), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n)))))


def windows(items: DataFrame, n: int) -> DataFrame:
    """(item_id, k, gram, h): every window of n words of every item, or all words of a shorter one; k is its length."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where("size(w) > 0")
    w = w.withColumn("k", F.least(F.size("w"), F.lit(n)))
    at = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1))
    return w.select("item_id", "k", "w", at.alias("at")).select("item_id", "k", F.array_join(F.slice("w", F.col("at"), F.col("k")), " ").alias("gram")).distinct()


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per row of docs: doc_id, n_words, hits (array of (at, k): verified windows, at from 0), items (sorted strings), contaminated.

    Null or wordless texts have no words and no hits; null item texts no windows; items of fewer than n
    words are one window. Equal item texts all count. Repeated rows, null doc_ids and equal doc_ids keep
    one result row each; empty tables give no rows or no hits. Other columns are ignored, whatever their names.
    A text may have any length: its words are held once, its windows are rows of a few numbers.

    One scan: each document's window hashes meet the broadcast set of benchmark hashes in the task that made them, and only
    hits, with the window's words to verify them, and one row per document are shuffled. Where the set is above BROADCAST_BYTES
    see _scan_large.
    """
    grams = cut(_by_hash(windows(benchmark, n), n))
    sizes = [r["k"] for r in grams.select("k").distinct().orderBy("k").collect()]  # n of them at most
    if grams.count() * 32 > BROADCAST_BYTES:
        return _scan_large(docs, grams, sizes)
    set_ = F.broadcast(grams.select(F.col("k").alias("wk"), F.col("h").alias("wh")).distinct())
    row = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    nothing = F.struct(F.lit(0).alias("k"), F.array(F.lit(None).cast("long")).alias("hs"))  # keeps documents without hits
    runs = let(_hashes(F.col("w")), lambda hs: F.array(nothing, *(F.struct(F.lit(k).alias("k"), _grams(hs, k).alias("hs")) for k in sizes)))
    each = row.select("row", "doc_id", "w", F.explode(runs).alias("run")).select("row", "doc_id", "w", F.col("run.k").alias("k"), F.posexplode("run.hs").alias("at", "h"))
    met = each.join(set_, (each["h"] == F.col("wh")) & (each["k"] == F.col("wk")), "left").where("k = 0 OR wh IS NOT NULL")
    met = met.select("row", "doc_id", F.when(F.col("k") == 0, F.size("w")).alias("n"), "k", "at", "h", F.when(F.col("k") > 0, _window()).alias("gram"))
    known = grams.select("k", "h", "gram", "items")
    known = F.broadcast(known) if _bytes(grams) <= BROADCAST_BYTES else known
    met = met.join(known, ["k", "h", "gram"], "left").where("k = 0 OR items IS NOT NULL")
    hit = F.when(F.col("k") > 0, F.struct("at", "k"))
    out = met.groupBy("row", "doc_id").agg(F.max("n").alias("n"), F.collect_list(hit).alias("hits"), F.collect_set("items").alias("its"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_words"), *_found())


def _by_hash(grams: DataFrame, n: int) -> DataFrame:
    """(k, h, gram, items): every window's hash, as documents' windows have it, and the items that hold it."""
    by = grams.groupBy("k", "gram").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    h = F.coalesce(*(F.when(F.col("k") == k, F.get(_grams(_hashes(F.split("gram", " ")), k), F.lit(0))) for k in range(1, n + 1)))
    return by.select("k", h.alias("h"), "gram", "items")


def _bytes(grams: DataFrame) -> int:
    return grams.agg(F.sum(F.length("gram") * 2 + 64 + 24 * F.size("items"))).first()[0] or 0


def _window() -> Column:
    return F.array_join(F.slice("w", F.col("at") + 1, F.greatest("k", F.lit(1))), " ")


def _found() -> list[Column]:
    return [F.array_sort("hits").alias("hits"), F.sort_array(F.array_distinct(F.flatten("its"))).alias("items"), (F.size("hits") > 0).alias("contaminated")]


def _scan_large(docs: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """scan() for a benchmark of any size: windows are shuffled as (text's sha256, position, hash), without their words.

    What they meet goes back to the texts, dealt by that sha256, to be verified there; equal texts are worked on once.
    """
    texts = docs.select(F.coalesce(F.sha2("text", 256), F.lit("")).alias("key"), words(F.col("text")).alias("w"))
    once = texts.dropDuplicates(["key"])
    runs = let(_hashes(F.col("w")), lambda hs: F.array(*(F.struct(F.lit(k).alias("k"), _grams(hs, k).alias("hs")) for k in sizes)))
    each = once.select("key", F.explode(runs).alias("run")).select("key", F.col("run.k").alias("k"), F.posexplode("run.hs").alias("at", "h")) if sizes else None
    if each is None:
        each = once.select("key", F.lit(1).alias("k"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("h")).limit(0)
    met = cut(each.join(grams.select("k", "h").distinct(), ["k", "h"]))
    verified = met.join(once, "key").select("key", "k", "at", "h", _window().alias("gram")).join(grams, ["k", "h", "gram"])
    found = verified.groupBy("key").agg(F.collect_list(F.struct("at", "k")).alias("hits"), F.collect_set("items").alias("its"))
    rows = docs.select("doc_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<struct<at:int,k:int>>"), F.array().cast("array<array<string>>")
    out = rows.join(found, "key", "left").withColumns({"hits": F.coalesce("hits", none[0]), "its": F.coalesce("its", none[1])})
    return out.select("doc_id", "n_words", *_found())


def covered(hits: Column) -> Column:
    """How many positions the sorted windows cover."""
    step = lambda acc, x: F.struct(
        F.greatest(acc["to"], x["at"] + x["k"]).alias("to"), (acc["n"] + F.greatest(x["at"] + x["k"] - F.greatest(acc["to"], x["at"]), F.lit(0))).alias("n")
    )
    return F.aggregate(hits, F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def digest(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    s = scan(docs, benchmark, n)
    return s.select(
        "doc_id", "n_words", covered(F.col("hits")).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """docs (same columns) without the rows that hold a window of the benchmark, whatever their doc_ids.

    Null, empty and wordless texts stay, an empty benchmark drops nothing, and repeated rows share a verdict. A verdict depends on the text alone, so the text's sha256 is the key by which exactly the hit rows go.
    """
    key = "__text_sha256"
    keyed = docs.withColumn(key, F.sha2("text", 256))
    hit = scan(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, n).where("contaminated")
    return without(keyed, hit.select("doc_id"), key).drop(key)
