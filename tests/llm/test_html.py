"""Shared runs decide about text outside articles; class words don't eat articles; odd pages and rows."""

import time

from tidewake.llm import html_text

TAIL = "this line is on every page of the site again"
PAGE = "page_id long, url string, html string"


def text_of(page):
    return " ".join(t for t, k in html_text.blocks(page)[1] if k == 2)


def generated():
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(12))
    page = lambda i: f'<body><article><p>teaser {i}</article><div>{own(i)}</div><div class="ad">{own(i + 50)}</div><p>{TAIL}</p></body>'
    marked = lambda i: f'<body class="no-sidebar"><nav>{own(i + 50)}</nav><div class="widget">{own(i)}</div><p>{TAIL}</p></body>'
    rows = [(i, "http://a.com/1", page(i)) for i in range(3)] + [(i, "http://b.com/1", marked(i)) for i in range(3, 6)]
    return rows, {i: f"teaser {i} {own(i)}" for i in range(3)} | {i: own(i) for i in range(3, 6)}


def extracted(spark, rows, schema=PAGE):
    return html_text.extract(spark.createDataFrame(rows, schema))


def test_op2_text_outside_articles(spark, monkeypatch):
    rows, want = generated()
    got = extracted(spark, rows).collect()
    assert {r.page_id: r.text for r in got} == want
    assert {(r.n_shared, r.n_marked) for r in got} == {(10, 12)}
    for name, value in (("BROADCAST_BYTES", -1), ("ARRAY_TOKENS", 8)):  # joined instead of broadcast; an array for each page
        monkeypatch.setattr(html_text, name, value)
        assert sorted(map(tuple, extracted(spark, rows).collect())) == sorted(map(tuple, got))


def test_op2_without_arrays(spark, monkeypatch):
    """The arrays' share of the result: without them the line that all pages have stays."""
    rows, want = generated()
    monkeypatch.setattr(html_text, "repeated_runs", lambda streams: streams.selectExpr("host", "n AS run").limit(0))
    assert {r.page_id: r.text for r in extracted(spark, rows).collect()} == {i: f"{t} {TAIL}" for i, t in want.items()}


def test_op2_class_words():
    page = '<article><div class="article-header"><h1>Title</h1></div><p class="lead">One</p><p class="social">Two</p><div class="share">no</div><p class="ad">no</p></article>'
    assert text_of(page) == "Title One Two"
    assert text_of('<nav><article class="related"><p>one</p></article>') == "one"
    assert text_of('<article><p>one</p><section class="comments"><article class="comment"><p>me</p></article></section></article>') == "one"
    assert text_of('<div id="comments"><article><p>me</p></article></div><article>one</article>') == "one"
    assert text_of("<article><p title=don't>one <b class='x>y'>two</b><option>no</article>") == "one two"


def test_op2_hostile_pages():
    for page in ('<a href="x ' * 20_000, "<" * 200_000, "<a " * 50_000, "<!--" * 50_000, '<p class="' * 20_001, "<b>" * 50_000, "<div>" * 50_000 + "</p>" * 50_000, "<svg><title>" * 5_000):
        began = time.time()
        html_text.blocks(page)
        assert time.time() - began < 5
    assert html_text.blocks('<a href="x <p>one</p> <p>two')[1] == [("one", 1), ("two", 1)]


def test_op2_odd_rows(spark):
    rows = [(None, None, None), (1, "x", ""), (1, "http://a.com", "<p>one"), (1, "http://a.com", "<p>one"), (None, "http://a.com", "<p>one"), (2, "http://a.com", "<p>" + "word " * 200_000)]
    schema = PAGE + ", key string, text string, n_chars string, covered int"
    got = extracted(spark, [(*r, "k", "t", "n", 1) for r in rows], schema).collect()
    assert sorted(((r.page_id, r.url, r.text[:9], r.n_chars) for r in got), key=str) == sorted([(i, u, "" if not p else "one" if "one" in p else "word word", 0 if not p else 3 if "one" in p else 10**6 - 1) for i, u, p in rows], key=str)
    assert extracted(spark, [], PAGE).count() == 0
