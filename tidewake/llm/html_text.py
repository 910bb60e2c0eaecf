"""HTML extraction: page markup to blocks, and suffix arrays of each host's text to tell boilerplate from content.

Markup gives the borders of blocks and what they are: text of an article (article, main, or what is marked as such), junk
(menus, adverts, forms, notices, comments and the like), or loose text. All text of a host's pages outside their articles
is put behind one another in token streams, whose suffixes are sorted: runs of RUN tokens or more that distinct pages
share are boilerplate and go, wherever they stand but in an article. What no run covers is arbitrated by markup: loose text
stays, what an element marks as junk goes, and what only a word of its class, id or role marks goes on pages with an
article and stays on others.

A token is covered by a repeated substring of RUN or more tokens exactly if it is covered by a repeated one of RUN tokens,
so sorting suffixes by their first RUN tokens finds what longer substrings would cover, however long.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded_batches, cut, keep, mix

#: Least tokens of a repeated run.
RUN = 8
#: Tokens of one suffix array: hosts with more are dealt by page to several, and their distinct runs are compared.
ARRAY_TOKENS = 1 << 14

_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_QUOTE_OR_END = re.compile("[\"'>]")
_NAMES = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# HTML's elements by what they mean here.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
JUNK = frozenset("nav header footer aside form dialog menu button fieldset head noscript template svg math object canvas select datalist option audio video".split())
ARTICLE = frozenset("article main".split())
#: An article's own text: only the strong words mark it.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figure figcaption".split())
#: Words of class, id or role that mark what isn't content: surely, as readers' comments, or probably.
STRONG_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe".split())
COMMENT_WORDS = frozenset("comment comments reply replies disqus".split())
WEAK_WORDS = frozenset(
    "banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead notice notices alert popup modal overlay subscription share sharing social related "
    "recommended login signup signin search pagination pager contentinfo complementary toolbar widget copyright skip".split()
)
#: Weak words that name an article's own head.
HEAD_WORDS = frozenset("header masthead banner".split())
ARTICLE_WORDS = frozenset(("articlebody", "main", "article"))
#: Elements whose end, or a block's start, closes an open paragraph.
_CLOSED_BY_BLOCK = frozenset("p dt dd li tr td th option".split())
#: How surely text is junk: by a weak word, by an element or a strong word, as a comment (which an article inside doesn't end).
WORD, ELEMENT, COMMENT = 1, 2, 3


def _marks(attributes: str) -> set[str]:
    return {w.lower() for m in _NAMES.finditer(attributes) for w in _WORDS.findall(m[1] or m[2] or m[3] or "")}


def _close(page: str, at: int) -> int:
    """Where the tag ends whose attributes begin at at: the next > outside quoted values, -1 if there is none."""
    while m := _QUOTE_OR_END.search(page, at):
        at = m.end()
        if m[0] == ">":
            return m.start()
        if page[max(0, m.start() - 200) : m.start()].rstrip().endswith("="):
            at = page.find(m[0], at) + 1
            if not at:
                break
    return -1


def _tags(page: str):
    """(start, end, closing, name, attributes) of each tag, comment or declaration (without a name); send() goes on from a place.

    One pass: once a quoted value doesn't end, tags of the rest of the page end at their first >, quoted or not.
    """
    at, strict = 0, True
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith(("!", "?"), at):
            opened, closed = next(x for x in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")) if page.startswith(x[0], start))
            stop = page.find(closed, start + len(opened))
            at = stop + len(closed) if stop >= 0 else len(page)
            yield start, at, "", "", ""
            continue
        m = _NAME.match(page, at)
        if m is None:
            continue
        stop = _close(page, m.end()) if strict else -1
        if stop < 0:
            strict, stop = False, page.find(">", m.end())
        if stop < 0:
            return
        at = stop + 1
        at = (yield start, at, m[1], m[2].lower(), page[m.end() : stop]) or at


def _level(name: str, marks: set[str], inside: bool) -> int:
    """How surely the words of an element's attributes mark it as junk."""
    if name in ("html", "body") or not marks:
        return 0
    if marks & COMMENT_WORDS:
        return COMMENT
    if marks & STRONG_WORDS:
        return ELEMENT
    weak = marks & WEAK_WORDS
    return WORD if weak and not (inside and (name in PROSE or name in INLINE or weak <= HEAD_WORDS)) else 0


def blocks(page: str) -> tuple[bool, list[tuple[str, int]]]:
    """Whether a page has an article, and its blocks in order as (text, kind): 2 article, 1 loose, 0 junk, 3 junk by weak words of its attributes alone.

    Character references are decoded and white space is made single. Elements left open end with the
    element around them; an article ends any junk but comments that was left open before it, and is never junk itself
    but as a comment.
    """
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int, bool]] = []  # (name, junk level, in article)
    opened: Counter = Counter()  # names on the stack
    buffer: list[str] = []
    has, at, end = False, 0, len(page)

    def shut(k):
        for x, _, _ in stack[k:]:
            opened[x] -= 1
        del stack[k:]

    def enter(name, junk, inside):
        stack.append((name, junk, inside))
        opened[name] += 1

    def flush():
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                junk, inside = (stack[-1][1], stack[-1][2]) if stack else (0, False)
                out.append((text, (2 if inside else 1) if not junk else 3 if junk == WORD else 0))

    found, go = _tags(page), None
    while True:
        try:
            start, stop, closing, name, attributes = found.send(go)
        except StopIteration:
            break
        go = None
        if start > at:
            buffer.append(page[at:start])
        at = stop
        if not name:
            continue
        if closing:
            if name in INLINE:
                if stack and stack[-1][0] == name:  # kept only where its class marks it
                    flush()
                    shut(len(stack) - 1)
                continue
            flush()
            if opened[name]:
                shut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            continue
        if name in RAW and not attributes.endswith("/"):
            flush()
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = go = close.end() if close else end
            continue
        if name in VOID:
            if name in ("br", "hr"):
                buffer.append(" ")
            continue
        marks = _marks(attributes) if "=" in attributes else set()
        if name in INLINE:
            _, before, inside = stack[-1] if stack else ("", 0, False)
            if junk := _level(name, marks, inside):
                flush()
                enter(name, max(before, junk), inside)
            continue
        flush()
        if name == "body":
            shut(0)
        if name in _CLOSED_BY_BLOCK or stack and stack[-1][0] == "p":
            while stack and stack[-1][0] in (("p",) if name not in _CLOSED_BY_BLOCK else ("p", name)):
                shut(len(stack) - 1)
        _, before, inside = stack[-1] if stack else ("", 0, False)
        junk = _level(name, marks, inside)
        if name in ARTICLE or not junk and marks & ARTICLE_WORDS and name in ("div", "section", "td"):
            junk = COMMENT if marks & {"comment", "reply"} else 0  # not "comments-open" and the like
            if not inside and max(before, junk) < COMMENT:
                before, inside, has = 0, True, True
        elif name in JUNK and not (inside and name == "header"):
            junk = max(junk, ELEMENT)
        if not attributes.endswith("/"):
            enter(name, max(before, junk), inside)
    if at < end:
        buffer.append(page[at:])
    flush()
    return has, out


def host(url: str | None) -> str:
    """What follows the first :// up to /, ? or #, lower-cased; empty for null or without ://."""
    m = re.search(r"://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


def _tokens(texts: list[str]) -> np.ndarray:
    """64-bit hashes of the texts' words, by Python's words and CRC-like mixing that every process repeats."""
    words = " ".join(texts).split()
    data = "\n".join(words).encode("utf-8", "surrogatepass")
    b = np.frombuffer(data + b"\n", np.uint8).astype(np.uint64)
    ends = np.flatnonzero(b == 10)
    place = np.arange(len(b), dtype=np.uint64) - np.repeat(np.concatenate([[0], ends[:-1] + 1]), np.diff(np.concatenate([[-1], ends]))).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix((b + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xD1B54A32D192ED03)), dtype=np.uint64)])
    return mix(sums[ends] - sums[np.concatenate([[0], ends[:-1] + 1])]) if words else np.empty(0, np.uint64)


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): suffixes sorted by their first depth tokens, by prefix doubling; equal ranks share them all.

    Suffixes of fewer tokens are padded with a token that nothing equals.
    """
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    size = 1
    while size < depth:
        step = min(size, depth - size)
        behind = np.concatenate([rank[step:], -np.arange(1, min(step, len(rank)) + 1)])
        _, rank = np.unique(rank * (2 * len(rank) + 2) + behind + len(rank), return_inverse=True)
        rank = rank.astype(np.int64) + 1
        size += step
    return np.argsort(rank, kind="stable"), rank


def repeated(streams: list[np.ndarray], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, first, last) of the distinct runs of run tokens in the streams, with the least and greatest stream that has each.

    The streams are put behind one another, with a token of its own between two, and their suffixes sorted.
    """
    joined = np.concatenate([x for i, s in enumerate(streams) for x in (s, mix(np.array([i], np.uint64)) | np.uint64(1))]) if streams else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    left = np.concatenate([np.arange(len(s), -1, -1) for s in streams]) if streams else np.empty(0, int)
    order, rank = suffix_array(joined, run)
    order = order[left[order] >= run]
    if not len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    head = np.flatnonzero(np.r_[True, np.diff(rank[order]) > 0])
    print_ = np.zeros(len(head), np.uint64)
    for k in range(run):
        print_ = mix(print_ * np.uint64(0x9E3779B97F4A7C15) + joined[order[head] + k])
    return print_.view(np.int64), np.minimum.reduceat(owner[order], head), np.maximum.reduceat(owner[order], head)


def runs(stream: np.ndarray, run: int = RUN) -> np.ndarray:
    """Fingerprints of the stream's runs, by position."""
    n = max(0, len(stream) - run + 1)
    out = np.zeros(n, np.uint64)
    for k in range(run):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + stream[k : k + n])
    return out.view(np.int64)


def _doubtful(has: bool) -> tuple[int, ...]:
    """Kinds of blocks that stay where no shared run covers them, on pages with an article and without."""
    return (1,) if has else (1, 3)


def _streams(batches):
    """Pages to (key, host, tokens, n): the stream of all text that isn't the article's."""
    for pdf in batches:
        out = []
        for key, url, page in zip(pdf["key"], pdf["url"], pdf["html"]):
            stream = _tokens([t for t, kind in blocks(page or "")[1] if kind != 2])
            out.append((key, host(url), stream.view(np.int64), len(stream)))
        yield pd.DataFrame(out, columns=["key", "host", "tokens", "n"])


def _array(pdf: pd.DataFrame) -> pd.DataFrame:
    """One suffix array: a part of a host's pages, which count once if their streams are equal."""
    streams, rows, seen = [], [], set()
    for t in pdf["tokens"]:
        s = np.asarray(t, np.int64).view(np.uint64)
        if s.tobytes() not in seen:
            seen.add(s.tobytes())
            streams.append(s)
            rows.append(int(mix(s).sum(dtype=np.uint64) >> np.uint64(1)))  # the stream itself, so that copies in other arrays are one
    prints, first, last = repeated(streams)
    rows = np.array(rows, np.int64)
    # A run's first and last stream differ if any two do, but their numbers needn't be the extremes: two that differ suffice.
    return pd.DataFrame({"host": pdf["host"].iloc[0], "run": prints, "least": np.minimum(rows[first], rows[last]), "most": np.maximum(rows[first], rows[last])})


def repeated_runs(streams: DataFrame) -> DataFrame:
    """(host, run): fingerprints of the runs that distinct streams of a host share.

    A host's pages are dealt to as many arrays as its tokens need, so no task holds more than about
    ARRAY_TOKENS of them (a longer page has an array of its own); an array sends each distinct run once.
    """
    size = streams.groupBy("host").agg(F.ceil(F.sum("n") / ARRAY_TOKENS).cast("long").alias("arrays"))
    parts = streams.where(f"n >= {RUN}").join(size, "host").withColumn("part", F.pmod(F.xxhash64("key"), F.greatest("arrays", F.lit(1))))
    each = parts.groupBy("host", "part").applyInPandas(_array, "host string, run long, least long, most long")
    return each.groupBy("host", "run").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most").select("host", "run")


def _with_host(prints: np.ndarray, name: str) -> np.ndarray:
    """Fingerprints of runs, each mixed with its host's name."""
    return mix(prints.view(np.uint64) ^ _tokens([name])[:1].sum(dtype=np.uint64))


def _judge(has: bool, found: list[tuple[str, int]], gone: np.ndarray) -> tuple[str, int, int]:
    """(text, tokens that shared runs took, tokens that markup alone took) of a page's blocks. gone: the tokens outside the article that runs cover."""
    kept, shared, marked, k = [], 0, 0, 0
    for t, kind in found:
        if kind == 2:
            kept.append(t)
            continue
        words = t.split()
        left = [w for w, g in zip(words, gone[k : k + len(words)]) if not g]
        k += len(words)
        shared += len(words) - len(left)
        if kind in _doubtful(has):
            kept += left
        else:
            marked += len(left)
    return " ".join(kept), shared, marked


_RESULT = "page_id long, url string, text string, n_chars long, n_shared long, n_marked long"


def _result(rows: list) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["page_id", "url", "text", "n_shared", "n_marked"]).astype({"page_id": "Int64"})
    df.insert(3, "n_chars", df["text"].map(len))
    return df


def _covered(stream: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Which tokens lie in a run whose place hit marks."""
    gone = np.zeros(len(stream) + RUN + 1, np.int64)
    gone[np.flatnonzero(hit)] += 1
    gone[np.flatnonzero(hit) + RUN] -= 1
    return np.cumsum(gone)[: len(stream)] > 0


def _finish(sent):
    """Pages against the sorted fingerprints of all shared runs."""

    def run(batches):
        known = sent.value
        for pdf in batches:
            out = []
            for i, url, page in zip(pdf["page_id"], pdf["url"], pdf["html"]):
                has, found = blocks(page or "")
                stream = _tokens([t for t, kind in found if kind != 2])
                prints = _with_host(runs(stream), host(url))
                at = np.searchsorted(known, prints)
                hit = known[np.minimum(at, len(known) - 1)] == prints if len(known) else np.zeros(len(prints), bool)
                out.append((i, url, *_judge(has, found, _covered(stream, hit))))
            yield _result(out)

    return run


def _finish_joined(batches):
    """Pages with the places of the shared runs that they hold."""
    for pdf in batches:
        out = []
        for i, url, page, places in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["covered"]):
            has, found = blocks(page or "")
            stream = _tokens([t for t, kind in found if kind != 2])
            hit = np.zeros(len(stream), bool)
            hit[np.asarray(places if places is not None else [], np.int64)] = True
            out.append((i, url, *_judge(has, found, _covered(stream, hit))))
        yield _result(out)


def _places(batches):
    for pdf in batches:
        for key, h, t in zip(pdf["key"], pdf["host"], pdf["tokens"]):
            r = runs(np.asarray(t, np.int64).view(np.uint64))
            yield pd.DataFrame({"key": [key] * len(r), "host": h, "at": np.arange(len(r), dtype=np.int32), "run": r})


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text (empty if none), n_chars, n_shared, n_marked.

    n_shared counts the tokens outside the article that runs of its host cover, n_marked those that markup alone removed.

    Null html counts as empty; pages with null or odd URLs share the host "". Repeated rows are one page
    for the suffix arrays and separate rows of the result, and null or equal page_ids don't matter: pages are known by a hash of
    url and html. An empty table gives no rows; html of any length is read in one pass, whole; other columns are ignored, whatever
    their names. Articles are kept whole, even if pages share them. Only the text outside articles is shuffled, unless the shared
    runs exceed BROADCAST_BYTES: then pages are joined with their places.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    key = F.unhex(F.md5(F.concat_ws("\n", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))))
    rows = pages.select("page_id", "url", "html")
    streams = keep(rows.select(key.alias("key"), "url", "html").mapInPandas(_streams, "key binary, host string, tokens array<long>, n long"))
    shared = cut(repeated_runs(streams))
    if shared.count() * 8 <= BROADCAST_BYTES:
        table = shared.toPandas()
        prints = [_with_host(g["run"].to_numpy(np.int64), h) for h, g in table.groupby("host")]
        sent = spark.sparkContext.broadcast(np.sort(np.concatenate(prints)) if prints else np.empty(0, np.uint64))
        return rows.mapInPandas(_finish(sent), _RESULT)
    hit = streams.dropDuplicates(["key"]).mapInPandas(_places, "key binary, host string, at int, run long").join(shared, ["host", "run"], "left_semi")
    covered = hit.groupBy("key").agg(F.collect_list("at").alias("covered"))
    return rows.withColumn("key", key).join(covered, "key", "left").select("page_id", "url", "html", "covered").mapInPandas(_finish_joined, _RESULT)
