"""N-gram Jaccard join: exact links between documents whose sets of word shingles are alike, and their components.

A set can only link to others through elements that it shares, so elements are first counted over the whole corpus.
Elements of one document alone come first in the common order and are never indexed; a set with too many of them has
no partner and leaves the join there. The sets that stay are indexed by prefix: rare elements first, each index entry
with its position and its set's size. Relations between sets save the rest of the work:

* lists are read by blocks (element, class, size): blocks of one class, and blocks whose best position and sizes leave
  too little overlap, are skipped unread;
* a set's overlap with another follows, within bounds, from that of a highly similar set (its pivot) that has been
  computed; only pairs that the bounds leave open are compared.

J(x, y) >= 0.8 is decided in integers: 9 * overlap >= 4 * (size x + size y).
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, keep, mix, slices, without
from .graph import components

WORDS = 5
#: Code points per bucket of elements; a bucket's elements are counted in one task.
BUCKET_CHARS, LEAST_BUCKETS = 6_000_000, 64
BATCH_CHARS = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C13)  # 3 mod 8: differences of its powers keep few factors of two
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ENTRY = np.uint64(2**48 - 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Each text's set: sorted 64-bit hashes of its distinct runs of words, or of all its words if they are fewer."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    b = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in data])])
    solid = ~_SPACE[b]
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(solid, _BYTE[b] * _powers(_BASE, len(b)), np.uint64(0)), dtype=np.uint64)])
    w = mix((sums[hi] - sums[lo]) * _powers(_INVERSE, len(b) + 1)[lo])
    first = np.searchsorted(lo, starts)
    run = np.zeros(max(0, len(w) - words + 1), np.uint64)
    for k in range(words):
        run = run * _BASE + w[k : k + len(run)]
    run = mix(run)
    out = []
    for a, z in zip(first[:-1], first[1:]):
        if z - a >= words:
            out.append(np.unique(run[a : z - words + 1]))
        elif z > a:
            h = np.array([z - a], np.uint64)
            for x in w[a:z]:
                h = h * _BASE + x
            out.append(mix(h))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _key(s: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ _BASE).sum(dtype=np.uint64)], np.uint64).tobytes()


_DEALT = "bucket long, batch long, head string, repeated binary, times binary, owners binary, docs binary, weights binary, low binary, high binary"
_COUNTED = "batch long, head string, repeated binary, times binary, owners binary, docs binary, elements binary, ranks binary"


def _element(entry: np.ndarray, bucket: np.ndarray | int, buckets: int) -> np.ndarray:
    """The number that stands for an element: 48 bits of its hash's quotient by buckets, and the remainder."""
    return entry * np.uint64(buckets) + np.asarray(bucket).astype(np.uint64)


def _deal(buckets: int, words: int):
    """Batches of documents to rows (bucket, batch, ...): the elements of one batch that fall in one bucket.

    A row holds 12 bytes for each of its elements and nothing that grows with the batch or the number of buckets, and empty
    buckets get none, so what is sent grows with the elements alone, whatever the corpus's size.

    What a batch repeats is summed before it is sent: equal sets send their elements once, for the first of them, and an
    element of several sets is sent once for the batch as a whole (the document after the last). Who has it stays with the
    batch: it travels with the head, which goes to a bucket by the batch's number. So an element that most documents have
    costs its bucket one entry a batch.
    """

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for pdf in batches:
            ids, texts = pdf["doc_id"].astype("Int64"), pdf["text"].fillna("").tolist()
            for a, z in slices(texts, BATCH_CHARS):
                sets, whole = shingles(texts[a:z], words), z - a
                n = np.fromiter(map(len, sets), np.uint32, whole)
                head = pd.DataFrame({"doc_id": ids[a:z].array, "n": n, "key": [_key(s) for s in sets]})
                weight = head.groupby("key")["key"].transform("size").to_numpy().astype(np.uint32)
                flat, doc = np.concatenate(sets), np.repeat(np.arange(whole, dtype=np.uint32), n)
                first = ~head["key"].duplicated().to_numpy()[doc]
                flat, doc = flat[first], doc[first]
                seen, where, times = np.unique(flat, return_inverse=True, return_counts=True)
                many = times > 1
                again = many[where]
                total = np.bincount(where, weight[doc], len(seen))[many].astype(np.uint32)
                owners = doc[again][np.argsort(where[again], kind="stable")]
                weights = np.concatenate([weight[doc[~again]], total])
                flat = np.concatenate([flat[~again], seen[many]])
                doc = np.concatenate([doc[~again], np.full(many.sum(), whole, np.uint32)])
                bucket, entry = (flat % np.uint64(buckets)).astype(np.int64), flat // np.uint64(buckets) & _ENTRY
                own = _element(entry[doc == whole], bucket[doc == whole], buckets)
                batch, number = (part << 32) + number, number + 1
                home = (head.assign(key=head["key"].map(bytes.hex)).to_json(orient="values"), own.tobytes(), times[many].astype(np.uint32).tobytes(), owners.tobytes())
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                starts = np.flatnonzero(np.diff(bucket, prepend=-1))
                some, lead, out = bucket[starts], batch % buckets, []
                for i, s, e in zip(some.tolist(), starts, [*starts[1:], len(order)]):
                    at = order[s:e]
                    q = entry[at]
                    out.append((i, batch, *(home if i == lead else (None,) * 4), doc[at].astype(np.uint16).tobytes(), weights[at].tobytes(), q.astype(np.uint32).tobytes(), (q >> np.uint64(32)).astype(np.uint16).tobytes()))
                if lead not in some:
                    out.append((lead, batch, *home, b"", b"", b"", b""))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _DEALT.split(", ")])

    return run


def _count(buckets: int):
    """One bucket: drops elements that one document alone has; the others get their (rounded) frequency."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        docs = [np.frombuffer(x, np.uint16) for x in pdf["docs"]]
        entry = np.frombuffer(b"".join(pdf["low"]), np.uint32).astype(np.uint64) | np.frombuffer(b"".join(pdf["high"]), np.uint16).astype(np.uint64) << np.uint64(32)
        seen, where = np.unique(entry, return_inverse=True)
        df = np.bincount(where, np.frombuffer(b"".join(pdf["weights"]), np.uint32), len(seen))
        rank = np.minimum(255, np.floor(4 * np.log2(np.maximum(df, 1)))).astype(np.uint8)[where]
        often, element = (df >= 2)[where], _element(entry, bucket, buckets)
        out, at = [], 0
        for row, d in zip(pdf[["batch", "head", "repeated", "times", "owners"]].itertuples(index=False), docs):
            k = at + np.flatnonzero(often[at : at + len(d)])
            if len(k) or row.head is not None:
                out.append((*row, d[k - at].tobytes(), element[k].tobytes(), rank[k].tobytes()))
            at += len(d)
        return pd.DataFrame(out, columns=[c.split()[0] for c in _COUNTED.split(", ")])

    return run


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    """One batch: a row per document; elements are the shared ones in the common order, null where too few are shared."""
    home = pdf[pdf["head"].notna()].iloc[0]
    head = json.loads(home["head"])
    doc = np.frombuffer(b"".join(pdf["docs"]), np.uint16).astype(np.int64)
    elem, rank = np.frombuffer(b"".join(pdf["elements"]), np.uint64), np.frombuffer(b"".join(pdf["ranks"]), np.uint8)
    # The batch's own entries become one for each of their owners.
    mine = doc == len(head)
    order = np.argsort(elem[mine])
    own, times = np.frombuffer(home["repeated"], np.uint64), np.frombuffer(home["times"], np.uint32)
    ranks = rank[mine][order][np.searchsorted(elem[mine][order], own)] if len(own) else np.empty(0, np.uint8)
    doc = np.concatenate([doc[~mine], np.frombuffer(home["owners"], np.uint32)])
    elem = np.concatenate([elem[~mine], np.repeat(own, times)]).view(np.int64)
    rank = np.concatenate([rank[~mine], np.repeat(ranks, times)])
    order = np.lexsort((elem, rank, doc))
    ends = np.searchsorted(doc[order], np.arange(len(head) + 1))
    elem = elem[order]
    rows, first = [], set()
    for i, (doc_id, size, key) in enumerate(head):
        shared = elem[ends[i] : ends[i + 1]]
        full = shared if key not in first and size and 5 * len(shared) >= 4 * size else None  # later copies have sent nothing
        first.add(key)
        rows.append((doc_id, size, bytes.fromhex(key) if size else None, full))
    return pd.DataFrame(rows, columns=["doc_id", "n", "key", "elements"]).astype({"doc_id": "Int64"})


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row of docs: doc_id, n (size of its set), key (null if empty), elements.

    elements: those that other rows share, in the common order (frequency, element); null where fewer than
    4/5 of the set are shared, as such a set has no link, and where an equal set of the same batch has them.
    """
    bounded_batches(docs.sparkSession)
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, chars // BUCKET_CHARS)
    dealt = docs.select("doc_id", "text").mapInPandas(_deal(buckets, words), _DEALT)
    counted = dealt.groupBy("bucket").applyInPandas(_count(buckets), _COUNTED)
    return counted.groupBy("batch").applyInPandas(_gather, "doc_id long, n int, key binary, elements array<long>")


#: Largest position (from 0) in a set's order that can hold its first common element, plus one: n - ceil(4 n / 5) + 1.
_PREFIX = "n - cast((4 * n + 4) div 5 AS int) + 1"
#: Least overlap of sets of sizes n and m: ceil(4 (n + m) / 9).
_NEED = "((4 * ({n} + {m}) + 8) div 9)"


def _index(distinct: DataFrame) -> DataFrame:
    """(e, key, n, at): prefix entries of distinct sets; at is the position with the unshared elements counted first."""
    own = distinct.select("key", "n", "elements", F.expr("n - size(elements)").alias("own"))
    own = own.where(f"own < {_PREFIX}")
    return own.select("key", "n", "own", F.posexplode(F.slice("elements", F.lit(1), F.expr(f"{_PREFIX} - own"))).alias("i", "e")).select("e", "key", "n", F.expr("own + i").alias("at"))


def _fits(a: str, b: str) -> str:
    """SQL: entries a and b can belong to linked sets, by size and by what their positions leave to overlap."""
    need = _NEED.format(n=f"{a}.n", m=f"{b}.n")
    return f"5 * {a}.n >= 4 * {b}.n AND 5 * {b}.n >= 4 * {a}.n AND least({a}.n - {a}.at, {b}.n - {b}.at) >= {need}"


def _overlaps(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with n_a, n_b and overlap."""
    s = distinct.select("key", "n", "elements")
    left = s.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("elements").alias("e_a"))
    right = s.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("elements").alias("e_b"))
    return pairs.join(left, "a").join(right, "b").withColumn("overlap", F.size(F.array_intersect("e_a", "e_b"))).drop("e_a", "e_b")


def _linked() -> str:
    return "9 * overlap >= 4 * (n_a + n_b)"


def _stars(index: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, overlap): links of sets with the leading set of a list that holds them; three lists a set.

    The three are no cap on links: a first guess that joins most of every group at the cost of a few comparisons for each set; what it misses
    is found by _crossings.
    """
    lead = index.groupBy("e").agg(F.min(F.struct("at", "key", "n")).alias("p")).select("e", F.col("p.key").alias("key"), F.col("p.n").alias("n"), F.col("p.at").alias("at"))
    met = index.alias("x").join(lead.alias("y"), F.expr(f"x.e = y.e AND x.key <> y.key AND {_fits('x', 'y')}"))
    best = met.groupBy(F.col("x.key").alias("a")).agg(F.slice(F.array_sort(F.collect_set(F.col("y.key"))), 1, 3).alias("bs"))
    return _overlaps(best.select("a", F.explode("bs").alias("b")), distinct).where(_linked())


def _crossings(index: DataFrame, distinct: DataFrame, label: DataFrame, pivots: DataFrame) -> DataFrame:
    """(a, b): all links between sets of different classes. label: (key, label); pivots: (key, pivot, lost, left).

    lost: elements of the set that its pivot lacks; left: elements of the pivot that the set lacks.
    """
    entry = index.join(label, "key")
    mixed = entry.groupBy("e").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("e")
    entry = cut(entry.join(mixed, "e").withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25)))))
    block = entry.groupBy("e", "label", "size").agg(F.min("n").alias("n"), F.max("n").alias("most"), F.max(F.expr("n - at")).alias("rest"))
    need = _NEED.format(n="x.n", m="y.n")
    met = block.alias("x").join(
        block.alias("y"), F.expr(f"x.e = y.e AND x.label < y.label AND 5 * x.most >= 4 * y.n AND 5 * y.most >= 4 * x.n AND least(x.rest, y.rest) >= {need}")
    )
    met = met.select(F.col("x.e").alias("e"), *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "xy" for c in ("label", "size")))
    side = lambda s: entry.select(F.col("e"), F.col("label").alias(f"label_{s}"), F.col("size").alias(f"size_{s}"), F.struct("key", "n", "at").alias(s))
    pairs = met.join(side("x"), ["e", "label_x", "size_x"]).join(side("y"), ["e", "label_y", "size_y"]).where(_fits("x", "y"))
    pairs = pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()

    # What the pivots' overlap says of a pair: it can gain each set's own elements and lose those that a set lacks.
    p = lambda s: pivots.select(*(F.col(c).alias(f"{c}_{s}") for c in ("pivot", "lost", "left")), F.col("key").alias(s))
    pairs = cut(pairs.join(p("a"), "a").join(p("b"), "b"))
    known = pairs.select(F.col("pivot_a").alias("a"), F.col("pivot_b").alias("b")).distinct()
    known = _overlaps(known, distinct).select(F.col("a").alias("pivot_a"), F.col("b").alias("pivot_b"), "n_a", "n_b", "overlap")
    told = pairs.join(known, ["pivot_a", "pivot_b"]).select(
        "a", "b", F.expr("n_a - left_a + lost_a").alias("n_a"), F.expr("n_b - left_b + lost_b").alias("n_b"), F.expr("overlap - left_a - left_b").alias("low"), F.expr("overlap + lost_a + lost_b").alias("high")
    )
    told = cut(told.where("9 * high >= 4 * (n_a + n_b)"))
    sure = told.where("9 * low >= 4 * (n_a + n_b)").select("a", "b")
    rest = _overlaps(told.where("9 * low < 4 * (n_a + n_b)").select("a", "b"), distinct).where(_linked()).select("a", "b")
    return sure.union(rest)


def _own_pivots(distinct: DataFrame, stars: DataFrame | None = None) -> DataFrame:
    """(key, pivot, lost, left) of every set: its most similar star, or itself."""
    if stars is None:
        return distinct.select("key", F.col("key").alias("pivot"), F.lit(0).alias("lost"), F.lit(0).alias("left"))
    best = stars.groupBy(F.col("a").alias("key")).agg(F.max(F.struct("overlap", F.col("b").alias("pivot"), "n_a", "n_b")).alias("s"))
    best = best.select("key", "s.pivot", F.expr("s.n_a - s.overlap").alias("lost"), F.expr("s.n_b - s.overlap").alias("left"))
    return distinct.select("key").join(best, "key", "left").select(
        "key", F.coalesce("pivot", "key").alias("pivot"), F.coalesce("lost", F.lit(0)).alias("lost"), F.coalesce("left", F.lit(0)).alias("left")
    )


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.where("elements IS NOT NULL").groupBy("key").agg(F.first("n").alias("n"), F.first("elements").alias("elements"))


def links(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(key_a, key_b): every link between different sets, for uses that need all of them. Documents' keys are in sets()."""
    distinct = keep(_distinct(keep(sets(docs, words))))
    index = keep(_index(distinct))
    return _crossings(index, distinct, distinct.select("key", F.col("key").alias("label")), _own_pivots(distinct)).toDF("key_a", "key_b")


def classes(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id.

    Documents link when their sets' Jaccard similarity is 0.8 or more; component_id is the least doc_id that
    links reach. Null or wordless texts have the empty set, link with nothing and keep their own doc_id;
    equal sets always link; repeated rows and equal doc_ids stay separate rows; null doc_ids take part, but
    never name a component unless all of it has none. An empty table gives no rows; a very long text is one
    set like any other, whole, held in one task at a time. Other columns are ignored, whatever their names.
    """
    rows = keep(sets(docs, words))
    distinct = keep(_distinct(rows))
    index = keep(_index(distinct))
    stars = cut(_stars(index, distinct))
    star = components(stars.select(F.col("a").alias("u"), F.col("b").alias("v")))
    label = distinct.select("key").join(star.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("label"))
    more = _crossings(index, distinct, label, _own_pivots(distinct, stars))
    cc = components(star.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    rows = rows.select("doc_id", "n", "key").join(cc.withColumnRenamed("node", "key"), "key", "left").withColumn("class", F.coalesce("component", "key"))
    # Written first, so that the join below is of two plain tables and Spark can split a class with very many rows.
    least = keep(rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least")))
    return rows.join(least, "class", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs (same columns) with exactly one row of each component: of the rows with its least doc_id (null comes last), one.

    Rows are told apart by 64 bits of (doc_id, text), on which their component depends too; of rows that are equal in
    both, one stays. Null or wordless texts have no component and stay, all of them.
    """
    key = "__row_key"
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = classes(keyed.select(F.col(key).alias("doc_id"), "text"), words).where("n_shingles > 0")
    found = found.groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("rows"), F.first("component_id").alias("component"))
    named = found.join(keyed.groupBy(key).agg(F.min("doc_id").alias("doc_id")), key)
    named = keep(named.select("component", "rows", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", key).alias("r")))
    best = keep(named.groupBy("component").agg(F.min("r").alias("best")))
    judged = named.join(best, "component").select(F.col(f"r.{key}").alias(key), "rows", (F.col(f"r.{key}") == F.col(f"best.{key}")).alias("stays"))
    judged = keep(judged)
    left = without(keyed, judged.where("NOT stays").select(key), key)
    again = judged.where("stays AND rows > 1").select(key)
    if not again.isEmpty():
        copies = keyed.join(again, key, "left_semi").dropDuplicates([key]).select(*keyed.columns)
        left = without(left, again, key).unionByName(copies)
    return left.drop(key)
