"""Quality scores by a generalised additive model with pairwise interactions.

Training boosts shallow trees cyclically: each round visits every feature once and adds a small tree on that feature
alone to its lookup table; then the strongest pairs of features get tables of their own the same way. A score is a sum
of table entries, looked up for whole batches at once.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, code_points, slices

#: At most about so many labelled rows are used for training: a share of the labels by hash of doc_id.
TRAIN_ROWS = 40_000
BINS, PAIR_BINS, PAIRS = 48, 8, 12
ROUNDS, PAIR_ROUNDS, RATE = 250, 80, 0.08
PRIOR = 1.0  # added to every leaf's curvature
THRESHOLD = 0.3

FEATURES = (
    "log_chars", "log_words", "word_length", "longest_word", "letters", "digits", "upper", "spaces", "stops", "symbols", "accents", "newlines",
    "distinct_words", "top_word", "repeats", "distinct_lines", "lines_repeated", "sentence_words", "run", "entropy", "capital_words", "marked_words",
)

_LETTER, _DIGIT, _UPPER, _SPACE, _STOP, _NEWLINE, _SYMBOL, _ACCENT = range(8)


def _classes() -> np.ndarray:
    """Bit set of the classes of each code point below 0x110000."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        kind = (_LETTER if c.isalpha() else _DIGIT if c.isdigit() else _SPACE if c.isspace() else _STOP if c in ".,;:!?'\"-()" else _SYMBOL)
        out[i] = 1 << kind | (c.isupper() << _UPPER) | ((c == "\n") << _NEWLINE) | ((i > 127 and c.isalpha()) << _ACCENT)
    out[0x3000:] = 1 << _LETTER | 1 << _ACCENT
    return out


_TABLE: list[np.ndarray] = []
_SENTENCE = re.compile(r"[.!?]+(?:\s|$)")


def features(texts: list[str]) -> np.ndarray:
    """One row of FEATURES for each text; all zero for an empty one."""
    if not _TABLE:
        _TABLE.append(_classes())
    out = np.zeros((len(texts), len(FEATURES)))
    col = {n: i for i, n in enumerate(FEATURES)}
    for a, b in slices(texts, 1 << 20):
        flat, offs = code_points(texts[a:b])
        n = np.diff(offs)
        some = np.flatnonzero(n)
        if not len(some):
            continue
        kinds = _TABLE[0][flat]
        share = {}
        for name, bit in (("letters", _LETTER), ("digits", _DIGIT), ("upper", _UPPER), ("spaces", _SPACE), ("stops", _STOP), ("newlines", _NEWLINE), ("symbols", _SYMBOL), ("accents", _ACCENT)):
            sums = np.concatenate([[0], np.cumsum((kinds >> bit) & 1, dtype=np.int64)])
            share[name] = (sums[offs[1:]] - sums[offs[:-1]])[some]
            out[a + some, col[name]] = share[name] / n[some]
        out[a + some, col["upper"]] = share["upper"] / np.maximum(share["letters"], 1)
        out[a + some, col["log_chars"]] = np.log1p(n[some])
        same = np.concatenate([[False], flat[1:] == flat[:-1]])
        same[offs[:-1][n > 0]] = False
        ends = np.flatnonzero(~same)
        runs = np.diff(np.concatenate([ends, [len(flat)]]))
        out[a + some, col["run"]] = np.log(np.maximum.reduceat(runs, np.searchsorted(ends, offs[:-1][some])))
        folded = np.minimum(flat, 383)
        for i in some:
            t = texts[a + i]
            c = np.bincount(folded[offs[i] : offs[i + 1]], minlength=384)
            p = c[c > 0] / n[i]
            words = t.split()
            k = max(len(words), 1)
            counts = Counter(words)
            lines = [x for x in t.split("\n") if x]
            seen = Counter(lines)
            row = out[a + i]
            row[col["entropy"]] = -(p * np.log(p)).sum()
            row[col["log_words"]] = np.log1p(len(words))
            row[col["word_length"]] = sum(map(len, words)) / k
            row[col["longest_word"]] = np.log1p(max(map(len, counts), default=0))
            row[col["distinct_words"]] = len(counts) / k
            row[col["top_word"]] = max(counts.values(), default=0) / k
            row[col["repeats"]] = sum(map(str.__eq__, words, words[1:])) / k
            row[col["distinct_lines"]] = len(seen) / max(len(lines), 1)
            row[col["lines_repeated"]] = sum(len(x) * (m - 1) for x, m in seen.items() if m > 1) / n[i]
            row[col["sentence_words"]] = np.log1p(k / (1 + len(_SENTENCE.findall(t))))
            row[col["capital_words"]] = sum(m for w, m in counts.items() if w[:1].isupper()) / k
            row[col["marked_words"]] = sum(m for w, m in counts.items() if not w[-1:].isalnum()) / k
    return out


@dataclass
class Model:
    """score(x) = sigmoid(base + sum of tables[j][bin of feature j] + sum of pair tables)."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, j], "right")]
        for j, k, ej, ek, t in self.pairs:
            z += t[np.searchsorted(ej, x[:, j], "right"), np.searchsorted(ek, x[:, k], "right")]
        return 1 / (1 + np.exp(-z))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="inverted_cdf")) if len(x) else np.empty(0)


def _leaf(g, h):
    return g / (h + PRIOR)


def _gain(g, h):
    return g * g / (h + PRIOR)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Bin values of a tree with at most three leaves over an ordered feature with gradient g and curvature h by bin."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    spans = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None, None)
        for s, e in spans:
            if e - s > 1:
                cg, ch = np.cumsum(g[s:e])[:-1], np.cumsum(h[s:e])[:-1]
                tg, th = g[s:e].sum(), h[s:e].sum()
                won = _gain(cg, ch) + _gain(tg - cg, th - ch) - _gain(tg, th)
                i = int(won.argmax())
                if won[i] > best[0]:
                    best = (won[i], (s, e), s + i + 1)
        if best[1] is None:
            break
        (s, e), m = best[1], best[2]
        spans.remove((s, e))
        spans += [(s, m), (m, e)]
        for x, y in ((s, m), (m, e)):
            out[x:y] = _leaf(g[x:y].sum(), h[x:y].sum())
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that splits a grid once each way (four leaves)."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    ag, ah = cg[:-1, :-1], ch[:-1, :-1]
    if not ag.size:
        return 0.0, np.zeros_like(g)
    rg, rh, kg, kh = cg[:-1, -1:], ch[:-1, -1:], cg[-1:, :-1], ch[-1:, :-1]
    cells = ((ag, ah), (rg - ag, rh - ah), (kg - ag, kh - ah), (tg - rg - kg + ag, th - rh - kh + ah))
    won = sum(_gain(*c) for c in cells) - _gain(tg, th)
    i, j = np.unravel_index(won.argmax(), won.shape)
    out = np.empty_like(g)
    for (x, y), c in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), cells):
        out[x, y] = _leaf(c[0][i, j], c[1][i, j])
    return float(won[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of labels y (0 or 1) by features x. Without rows of both kinds it is constant."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(p / (1 - p))), [np.empty(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    if not 0 < y.sum() < len(y):
        return model
    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    z = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j, t in enumerate(model.tables):
            q = 1 / (1 + np.exp(-z))
            step = RATE * _tree(np.bincount(bins[j], y - q, len(t)), np.bincount(bins[j], q * (1 - q), len(t)))
            t += step
            z += step[bins[j]]
    for t, b in zip(model.tables, bins):  # each table averages to nothing
        m = t[b].mean()
        t -= m
        model.base += m
    coarse = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    cb = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)]

    def grid(j, k):
        shape = (len(coarse[j]) + 1, len(coarse[k]) + 1)
        at = cb[j] * shape[1] + cb[k]
        q = 1 / (1 + np.exp(-z))
        return at, *(np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (y - q, q * (1 - q)))

    won = sorted(((_cross(*grid(j, k)[1:])[0], j, k) for j in range(x.shape[1]) for k in range(j + 1, x.shape[1])), reverse=True)[:PAIRS]
    model.pairs = [(j, k, coarse[j], coarse[k], np.zeros((len(coarse[j]) + 1, len(coarse[k]) + 1))) for _, j, k in won]
    for _ in range(PAIR_ROUNDS):
        for j, k, _, _, t in model.pairs:
            at, g, h = grid(j, k)
            step = RATE * _cross(g, h)[1]
            t += step
            z += step.reshape(-1)[at]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of labels.quality, learned from labelled rows that are not held out, about rows of them at most.

    Only their ids (a bounded broadcast) go to the documents' scan, and only their features come back. Equal
    ids with different labels count by their majority (ties: 1); null ids, labels other than 0 and 1 and
    labels without a document don't count.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    used = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y")

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["y"], "x": list(features(pdf["text"].fillna("").tolist()))})

    got = used.mapInPandas(run, "y int, x array<double>").toPandas()
    order = np.lexsort([*np.array(got["x"].tolist()).T, got["y"]]) if len(got) else []  # sums in one order, however rows arrive
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))[order] if len(got) else np.zeros((0, len(FEATURES)))
    return fit(x, got["y"].to_numpy(float)[order] if len(got) else np.zeros(0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    score is the estimated probability of label 1; predicted is 1 from THRESHOLD on. Null text counts as
    empty and is scored like it. Nothing but the text enters a score, so repeated rows agree and null or equal doc_ids don't
    matter. Very long texts are scored whole, an empty table gives no rows, other columns are ignored, whatever their names.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for pdf in batches:
            s = sent.value.score(features(pdf["text"].fillna("").tolist()))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64").array, "held_out": pdf["held_out"].array, "score": s, "predicted": (s >= THRESHOLD).astype(np.int32)})

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
