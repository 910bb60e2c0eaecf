"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, code_points, mix, slices

ORDER = 4
_BITS = np.uint64(16)
#: What a text's excess over its language's cross-entropy is measured by: chance, and SPREAD of that cross-entropy, by
#: which documents of the language differ besides.
SPREAD = 0.1
#: One in FOLDS of the training texts, by hash, calibrates the rejection: against models of the others, a language's limit
#: lies REACH times as far above the median excess of its texts as their QUANTILE does. For a bell curve that is 9
#: standard deviations, so rejected texts are no tail of the language. Languages with fewer than LEAST texts there take FALLBACK.
FOLDS, QUANTILE, REACH, LEAST, FALLBACK = 4, 0.99, 4.0, 100, 12.0
#: Symbols that a document can count for in its score: characters of a text are not independent.
EVIDENCE = 40
#: Code points that are counted or scored at once.
AT_ONCE = 1 << 18


@functools.cache
def _symbols() -> np.ndarray:
    """Code point to 16-bit symbol: lower-cased letters; 0 for everything else."""
    out = np.zeros(0x110000, np.uint16)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            k = ord(c.lower()[0])
            out[i] = k if k < 0x10000 else (k * 40503 & 0xFFFF) | 1
    return out


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, ends): every text's ORDER-grams as packed 64-bit codes, and where each text's end.

    Letters are lower-cased, any run of other characters is one space (0), and what precedes a text counts as spaces.
    A text without a letter has none.
    """
    flat, offs = code_points(texts)
    sym = _symbols()[flat]
    starts = offs[:-1][np.diff(offs) > 0]
    stop = np.concatenate([[0], sym[:-1]]).astype(np.uint16) if len(sym) else sym
    stop[starts] = 0
    use = (sym != 0) | (stop != 0)
    kept = np.concatenate([[0], np.cumsum(use)])[offs]
    sym = sym[use].astype(np.uint64)
    place = np.arange(len(sym)) - np.repeat(kept[:-1], np.diff(kept))
    code = sym.copy()
    for k in range(1, ORDER):
        if len(sym) > k:
            code[k:] |= np.where(place[k:] >= k, sym[:-k], np.uint64(0)) << (_BITS * np.uint64(k))
    return code, kept[1:]


class HashArray:
    """Distinct 64-bit codes as a sorted array of their mixed hashes, with a directory by leading bits."""

    def __init__(self, codes: np.ndarray):
        h = mix(codes)
        self.order = np.argsort(h)
        self.keys = np.concatenate([h[self.order], np.full(1, np.iinfo(np.uint64).max, np.uint64)])
        bits = max(1, int(len(codes) * 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Each code's place in the array, -1 if it isn't there."""
        h = mix(codes)
        at = self.first[(h >> self.shift).astype(np.int64)]
        key = self.keys[at]
        out = np.where(key == h, at, -1)
        left = np.flatnonzero(key < h)
        while len(left):
            at[left] += 1
            key = self.keys[at[left]]
            same = left[key == h[left]]
            out[same] = at[same]
            left = left[key < h[left]]
        out[out >= len(self.keys) - 1] = -1
        return out


class Model:
    """log p by language of every seen n-gram of each order, and the back-off weights of the contexts."""

    def __init__(self, langs: list[str], lang: np.ndarray, code: np.ndarray, n: np.ndarray):
        self.langs, size = langs, max(1, len(langs))
        codes, where = np.unique(code.astype(np.uint64), return_inverse=True)
        counts = np.zeros((len(codes), size))
        np.add.at(counts, (where, lang), n)
        levels = [(codes, counts)]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: how many different symbols precede it
            low = levels[0][0] & ((np.uint64(1) << (_BITS * np.uint64(k))) - np.uint64(1))
            codes_k, to = np.unique(low, return_inverse=True)
            c = np.zeros((len(codes_k), size))
            np.add.at(c, to, (levels[0][1] > 0).astype(float))
            levels.insert(0, (codes_k, c))
        self.tables: list = []
        vocabulary = len(levels[0][0]) + 1
        lower = np.full((1, size), 1.0 / vocabulary)  # below order 1: every symbol alike
        self.unseen = None
        for k, (codes_k, c) in enumerate(levels, 1):
            once, twice = (c == 1).sum(0), (c == 2).sum(0)
            d = np.where(once + twice > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
            d = np.clip(d, 0.05, 0.95)
            context, to = np.unique(codes_k >> _BITS, return_inverse=True)
            total, kinds = np.zeros((len(context), size)), np.zeros((len(context), size))
            np.add.at(total, to, c)
            np.add.at(kinds, to, (c > 0).astype(float))
            weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            if k == 1:
                below = np.repeat(lower, len(codes_k), 0)
                self.unseen = np.log(np.where(total.any(0), weight[0], 1.0) / vocabulary) if len(context) else np.log(lower[0])
            else:
                below = np.exp(self._rows(k - 1, codes_k & ((np.uint64(1) << (_BITS * np.uint64(k - 1))) - np.uint64(1))))
            p = np.where(total[to] > 0, np.maximum(c - d, 0) / np.maximum(total[to], 1), 0.0) + weight[to] * below
            table, contexts = HashArray(codes_k), HashArray(context)
            self.tables.append((table, np.log(p)[table.order].astype(np.float32), contexts, np.log(weight)[contexts.order].astype(np.float32)))
        # Over everything that was counted: each language's own cross-entropy and its variance per symbol.
        top = self._rows(ORDER, codes) if len(codes) else np.zeros((0, size))
        sums = np.maximum(counts.sum(0), 1)
        self.entropy = -(counts * top).sum(0) / sums
        self.variance = (counts * (top + self.entropy) ** 2).sum(0) / sums
        self.limits = np.full(size, FALLBACK)

    def _rows(self, k: int, codes: np.ndarray) -> np.ndarray:
        """log p of k-grams in every language; a gram that no language has backs off."""
        table, logs, contexts, weights = self.tables[k - 1]
        at = table.find(codes)
        out = logs[np.maximum(at, 0)] if len(logs) else np.zeros((len(codes), len(self.unseen)), np.float32)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            c = codes[miss]
            if k == 1:
                out[miss] = self.unseen
            else:
                low = self._rows(k - 1, c & ((np.uint64(1) << (_BITS * np.uint64(k - 1))) - np.uint64(1)))
                ctx = contexts.find(c >> _BITS)
                out[miss] = low + np.where((ctx >= 0)[:, None], weights[np.maximum(ctx, 0)], 0) if len(weights) else low
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol of each text in each language, and each text's symbols (0: no letter)."""
        out, size = np.zeros((len(texts), max(1, len(self.langs)))), np.zeros(len(texts), np.int64)
        for a, b in slices(texts, AT_ONCE):
            codes, ends = grams(texts[a:b])
            n = np.diff(np.concatenate([[0], ends]))
            size[a:b] = n
            if len(codes):
                some = np.flatnonzero(n)
                start = (ends - n)[some]
                total = np.zeros((len(some), out.shape[1]))
                for i in range(0, len(codes), AT_ONCE):  # a very long text is summed in parts
                    j = min(i + AT_ONCE, len(codes))
                    within = np.flatnonzero((start < j) & (ends[some] > i))
                    total[within] += np.add.reduceat(self._rows(ORDER, codes[i:j]), np.maximum(start[within] - i, 0), axis=0, dtype=np.float64)
                out[a + some] = -total / n[some][:, None]
        return out, size

    def predict(self, texts: list[str]) -> pd.DataFrame:
        """lang_pred, score, entropy, excess, rejected of each text."""
        h, n = self.entropies(texts)
        known = (n > 0) & bool(self.langs)
        best = h.argmin(1)
        gap = h - h.min(1, keepdims=True)
        score = 1 / np.exp(-gap * np.minimum(n, EVIDENCE)[:, None]).sum(1)
        e, v = (self.entropy[best], self.variance[best]) if self.langs else (np.zeros(len(texts)), np.zeros(len(texts)))
        excess = (h.min(1) - e) / np.sqrt(np.maximum((SPREAD * e) ** 2 + v / np.maximum(n, 1), 1e-12))
        names = np.array([*self.langs, "und"], object)
        return pd.DataFrame({
            "lang_pred": names[np.where(known, best, len(self.langs))],
            "score": np.where(known, score, 0.0),
            "entropy": np.where(known, h.min(1), np.nan),
            "excess": np.where(known, excess, np.nan),
            "rejected": ~known | (excess > self.limits[best]),
        })


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, n = (np.concatenate(x) for x in zip(*parts))
    codes, where = np.unique(codes, return_inverse=True)
    return codes, np.bincount(where, n, len(codes)).astype(np.int64)


def _count(batches):
    """(lang, code, n, aside) of a partition's ORDER-grams, summed before they are sent on; aside: those of calibrating texts."""
    held: dict[tuple, list] = {}
    for pdf in batches:
        for key, texts in pdf.groupby(["lang", "aside"])["text"]:
            texts = texts.tolist()
            parts = held.setdefault(key, [])
            for a, b in slices(texts, AT_ONCE):
                codes, n = np.unique(grams(texts[a:b])[0], return_counts=True)
                parts.append((codes, n))
            if sum(len(c) for c, _ in parts) > 1_000_000:
                parts[:] = [_merge(parts)]
    for (lang, aside), parts in held.items():
        codes, n = _merge(parts)
        yield pd.DataFrame({"lang": lang, "code": codes.view(np.int64), "n": n, "aside": n if aside else 0})


def train(docs: DataFrame) -> Model:
    """The models of the languages in docs (text, lang), counted over all of its rows; null text or lang is left out.

    Tasks send one row per language and n-gram that they have seen; what reaches the driver are the
    distinct ORDER-grams of each language, 24 bytes each: their number is bounded by the languages' alphabets and grows with what
    new grams the corpus has, none are cut off. Rejection is calibrated on texts that the models which judge them have not
    counted (see FOLDS); the models that are returned have counted all.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", (F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 1).alias("aside"))
    sums = rows.mapInPandas(_count, "lang string, code long, n long, aside long").groupBy("lang", "code").agg(F.sum("n").alias("n"), F.sum("aside").alias("aside"))
    counts = sums.toArrow()
    lang = counts["lang"].to_pandas()
    langs = sorted(lang.unique())
    place = lang.map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64)
    code, n, aside = counts["code"].to_numpy().view(np.uint64), counts["n"].to_numpy(), counts["aside"].to_numpy()
    model = Model(langs, place, code, n)
    left = n > aside
    if langs and left.any():
        _calibrate(model, Model(langs, place[left], code[left], (n - aside)[left]), rows.where("aside").select("text"))
    return model


def _calibrate(model: Model, other: Model, texts: DataFrame) -> None:
    """Sets the model's limits by how far the texts, which the other model has not counted, exceed its languages' cross-entropies."""
    sent = texts.sparkSession.sparkContext.broadcast(other)

    def run(batches):
        for pdf in batches:
            yield sent.value.predict(pdf["text"].tolist())[["lang_pred", "excess"]].dropna()

    judged = texts.mapInPandas(run, "lang_pred string, excess double").groupBy("lang_pred")
    for r in judged.agg(F.percentile_approx("excess", [0.5, QUANTILE], 10_000).alias("q"), F.count("*").alias("n")).collect():
        if r.n >= LEAST:
            model.limits[model.langs.index(r.lang_pred)] = r.q[0] + REACH * (r.q[1] - r.q[0])


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score, entropy, rejected.

    lang_pred is the language whose model has the lowest cross-entropy per symbol (the first by name of
    equals), und for null texts and texts without a letter; score is its share of the likelihood over at
    most EVIDENCE symbols, 0 for und. rejected: und, or a cross-entropy that the language's own does not
    explain (see FOLDS). Repeated rows agree; very long texts are scored whole, in parts; an empty table gives no rows; nothing but the text enters a prediction. Without a model
    it learns from the rows of docs with a lang that are not held out; without such rows all are und.
    """
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))) if model is None else model
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            out = sent.value.predict(pdf["text"].fillna("").tolist()).drop(columns="excess")
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").array)
            out.insert(1, "held_out", pdf["held_out"].array)
            yield out

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double, entropy double, rejected boolean")


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs (same columns) without the rows that predict() rejects. Rows are judged one by one: null or equal doc_ids don't matter."""
    model = train(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))) if model is None else model
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def rejects(text: pd.Series) -> pd.Series:
        return sent.value.predict(text.fillna("").tolist())["rejected"]

    bounded_batches(docs.sparkSession)
    return docs.where(~rejects("text"))
