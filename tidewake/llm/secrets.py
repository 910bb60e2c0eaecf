"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: kind -> pattern, in the order that settles ties.
BASE = {
    "assign": r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{12,}",  # 16 or more of the greedy run: shorter runs hold no longer one
    "hex": r"[0-9a-f]{32,}",
}
ASSIGN_VALUE = r"(?s)^.*?[:=]\x20*[\"']?"
ASSIGN_LEAST = 8
#: What the models judge: runs of this alphabet, 12 characters or more, with a letter (numbers, dates and rules have none).
#: Below 12 the margin tells less: of ordinary runs in source code and prose it takes 2 % at 10 characters and 4 % at 8.
CANDIDATE = r"[A-Za-z0-9+/_=-]{12,}"
#: Ordinary identifiers that train the other model: letters, possibly joined by _ or -, as words stand in prose and code.
IDENTIFIER = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]+(?:[_-][A-Za-z]+)*(?![A-Za-z0-9+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(ALPHABET) + 1  # 0: the start
#: Nats per character by which the random model must win.
MARGIN = 0.5
#: Elements of a block: what a fold may copy for each element.
BLOCK = 128
#: Stands for each code point of a base span where the models look; no candidate holds it.
HIDDEN = " "


def _blocks(values: Column) -> Column:
    """The array cut into arrays of BLOCK elements; none for an empty one."""

    def cut(vs):
        n = F.ceil(F.size(vs) / BLOCK).cast("int")
        return F.transform(F.filter(F.sequence(F.lit(0), n), lambda b: b < n), lambda b: F.slice(vs, b * BLOCK + 1, F.lit(BLOCK)))

    return let(values, cut)


def _scan(values: Column, first: Column, join) -> Column:
    step = lambda acc, x: F.struct(join(acc["t"], x).alias("t"), F.array_append(acc["out"], acc["t"]).alias("out"))
    return F.aggregate(values, F.struct(first.alias("t"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])


def running(values: Column, join) -> Column:
    """What join makes, from 0 on, of the elements before each one of an int array.

    In two levels, blocks and their totals: appending to an array copies it, so one fold over n elements would copy n * n / 2.
    """
    total = lambda b: F.aggregate(b, F.lit(0), join)
    return let(_blocks(values), lambda bs: F.flatten(F.zip_with(bs, _scan(F.transform(bs, total), F.lit(0), join), lambda b, t: _scan(b, t, join))))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """All matches as structs (start, end, kind, value) in code points: pieces between matches and matches, added up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    span = lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), F.lit(kind).alias("kind"), m.alias("value"))

    def placed(ms):
        sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(ms)), ms, lambda p, m: F.length(p) + F.length(m))
        return let(sizes, lambda ls: F.zip_with(F.zip_with(running(ls, _plus), ls, _plus), ms, span))

    none = F.array().cast("array<struct<start:int,end:int,kind:string,value:string>>")
    return F.when(text.rlike(pattern), let(found, placed)).otherwise(none)


def replaced(text: Column, spans: Column, fill) -> Column:
    """The text with fill(length) for each of the spans (sorted by start); of a span that overlaps those before it, the
    rest only. length is what the span adds, or 0 for an overlapping one if it adds nothing.

    By blocks of spans: a block's part of the text is cut out first, so that no span looks for its place from the text's start.
    """

    def pieces(b):  # a block of structs (from, start, end): from is where the spans before it end
        low = F.get(b, F.lit(0))["from"]
        high = F.aggregate(b, F.lit(0), lambda m, s: F.greatest(m, s["end"]))
        part = F.substr(text, low + 1, F.greatest(high - low, F.lit(0)))
        gap = lambda t, s: F.substr(t, s["from"] - low + 1, F.greatest(s["start"] - s["from"], F.lit(0)))
        return let(part, lambda t: F.array_join(F.transform(b, lambda s: F.concat(gap(t, s), fill(s["end"] - F.greatest(s["start"], s["from"]), s["start"] >= s["from"]))), ""))

    ends = F.transform(spans, lambda s: s["end"])
    placed = F.zip_with(running(ends, _most), spans, lambda f, s: F.struct(f.alias("from"), s["start"].alias("start"), s["end"].alias("end")))
    whole = lambda bs: F.array_join(F.transform(bs, pieces), "")
    return F.concat(let(_blocks(placed), whole), F.substr(text, F.aggregate(ends, F.lit(0), _most) + 1))


def base_spans(text: Column) -> Column:
    """The fixed patterns' spans, unordered; a match whose value or run is too short is dropped, and still hides what it covers."""
    assign = F.filter(_spans(text, "assign", BASE["assign"]), lambda s: F.length(F.regexp_replace(s["value"], ASSIGN_VALUE, "")) >= ASSIGN_LEAST)
    return F.concat(assign, _spans(text, "access", BASE["access"]), _spans(text, "hex", BASE["hex"]))


def _cells(token: Column) -> Column:
    """The token's transitions as cells of a SIDE x SIDE table."""
    at = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.zip_with(F.array_prepend(F.slice(at, 1, F.size(at) - 1), F.lit(0)), at, lambda a, b: a * SIDE + b)


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios, random over ordinary, of all SIDE * SIDE transitions (add-half smoothing).

    The labelled samples are the corpus's own, all of them: values that the fixed patterns caught are random strings;
    letter-only identifiers are ordinary, summed up by identifier first, each as often as it stands in the corpus. Only counts by
    cell reach the driver: SIDE * SIDE * 2 rows at most, whatever the input. Without either kind of
    sample the smoothing stands alone: uniform transitions.
    """
    text = F.col("text")
    caught = docs.where(text.rlike("|".join(BASE.values()))).select(F.explode(base_spans(text)).alias("s"))
    value = F.when(F.col("s.kind") == "assign", F.regexp_replace("s.value", ASSIGN_VALUE, "")).otherwise(F.col("s.value"))
    random = caught.select(value.alias("token")).where(f"token RLIKE '^{CANDIDATE[:-5]}{{8,}}$' AND token RLIKE '[0-9]'").select(F.lit(1).alias("random"), "token", F.lit(1).cast("long").alias("n"))
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))).alias("token"))
    plain = words.where(F.length("token") >= 4).groupBy("token").agg(F.count("*").alias("n")).select(F.lit(0).alias("random"), "token", "n")
    cased = F.explode(F.array("token", F.upper("token"), F.lower("token")))  # neither model may lean on one case
    cells = random.union(plain).select("random", "n", cased.alias("token")).select("random", "n", F.explode(_cells(F.col("token"))).alias("cell"))
    counts = {(r["random"], r["cell"]): r["n"] for r in cells.groupBy("random", "cell").agg(F.sum("n").alias("n")).collect()}
    return _ratios(counts)


def _ratios(counts: dict[tuple[int, int], int]) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary), by cell a * SIDE + b."""
    import math

    out = []
    for a in range(SIDE):
        rows = [[counts.get((k, a * SIDE + b), 0) + 0.5 for b in range(SIDE)] for k in (0, 1)]
        sums = [sum(r) for r in rows]
        out += [math.log(rows[1][b] / sums[1]) - math.log(rows[0][b] / sums[0]) for b in range(SIDE)]
    return out


def markov_spans(text: Column, ratios: list[float], margin: float = MARGIN) -> Column:
    """Candidate runs with a letter whose mean log-likelihood ratio reaches the margin, as spans of kind markov."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # one literal, folded once

    def wins(s):
        cells = _cells(s["value"])
        total = F.aggregate(cells, F.lit(0.0), lambda acc, c: acc + F.get(table, c))
        return total / F.size(cells) >= margin

    return F.filter(_spans(text, "markov", CANDIDATE), lambda s: s["value"].rlike("[A-Za-z]") & wins(s))


def _order(s: Column) -> Column:
    """A span with its kind's rank before the end, so that sorting goes by start, then kind as listed."""
    rank = F.when(s["kind"] == "assign", 0).when(s["kind"] == "access", 1).when(s["kind"] == "hex", 2).otherwise(3)
    return F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))


def scan(docs: DataFrame, ratios: list[float] | None = None, margin: float = MARGIN, base: str = "base", found: str = "found") -> DataFrame:
    """docs with two more columns, named base and found: sorted arrays of structs (start, rank, end, kind), code points, end exclusive.

    base holds the spans of the fixed patterns; found also those of the Markov models, which see the text with the base
    spans blanked out. Null text counts as empty and has none; an empty table gives an empty one. A row's spans depend on
    its text and the trained table alone, so repeated rows agree and ids don't matter; equal starts go by kind as listed.
    Work grows in proportion to a text's length and spans, however many. A column of docs that is called as base or found
    says is replaced. The models are trained on docs unless their table is given.
    """
    ratios = train(docs) if ratios is None else ratios
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn(base, F.array_sort(F.transform(base_spans(text), _order)))
    blank = F.when(F.size(base) > 0, replaced(text, F.col(base), lambda n, _: F.repeat(F.lit(HIDDEN), n))).otherwise(text)
    hidden = "__blanked"
    more = F.transform(markov_spans(F.col(hidden), ratios, margin), _order)
    return out.withColumn(hidden, blank).withColumn(found, F.array_sort(F.concat(F.col(base), more))).drop(hidden)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs.select("doc_id", "text"), **options)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """docs (same columns) with every found span replaced by mark, overlapping spans as one; n_chars follows. Null text stays null.

    Rows are worked on one by one: null or equal doc_ids, repeated rows and empty tables need no care, and other columns stay as they are.
    """
    out = scan(docs, base="__base", found="__found", **options)
    text = F.col("text")
    new = F.when(F.size("__found") > 0, replaced(text, F.col("__found"), lambda n, apart: F.when(apart, F.lit(mark)).otherwise(F.lit("")))).otherwise(text)
    cols = {c: F.col(c) for c in docs.columns} | {"text": new}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(F.size("__found") > 0, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*(c.alias(n) for n, c in cols.items()))
