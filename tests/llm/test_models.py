"""Extraction, licences, quality, language, segmentation and the pipeline: definitions, held-out accuracy, odd rows."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewake.llm import html_text, langid, licenses, ngram_join, pieces, quality
from tidewake.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en"), (2, "", None), (3, " \n\t", "en"), (4, "the cat", "en"), (4, "the cat", "en"), (None, "der hund", "de"), (None, None, None), (7, "x" * 200_000, "fr"), (8, "a ▁ b\0c", "es")]
    return spark.createDataFrame([(i, t, g, "s", None, "mine", 5) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, ids int")


def test_op2_articles(spark):
    pages = table(spark, SF, "pages")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert len(got) == pages.count()
    import html

    for p in pages.collect():
        body = re.search("<article>(.*)</article>", p.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(p|h1|br)>", " ", body).replace("<b>", "").replace("</b>", "")).split())
        assert (got[p.page_id].text, got[p.page_id].n_chars) == (want, len(want))


def test_op2_blocks():
    text = lambda page: [t for t, k in html_text.blocks(page)[1] if k == 2]
    page = '<body><nav>menu<p>open<article class="post"><header><h1>T&eacute;st</h1></header><p>one<br>two <b>bo</b>ld<p>three<div class="ad">buy</div><aside>side</aside><form>q</form><script>x<p></script><ul><li>a<li>b</ul><section id="comments"><p>me</section></article><footer>f</footer>'
    assert text(page) == ["Tést", "one two bold", "three", "a", "b"]
    assert html_text.blocks("<p>a &lt; b<!-- <p>no --> c")[1] == [("a < b c", 1)]
    assert html_text.blocks("") == (False, []) and html_text.blocks("<")[1] == [("<", 1)]


def test_op2_suffix_arrays(spark):
    rnd = random.Random(3)
    streams = [np.array([rnd.randrange(4) for _ in range(120)], np.uint64) for _ in range(5)]
    prints, first, last = html_text.repeated(streams, 4)
    want = {}
    for i, s in enumerate(streams):
        for f in html_text.runs(s, 4).tolist():
            a, b = want.get(f, (i, i))
            want[f] = (min(a, i), max(b, i))
    assert {p: (a, b) for p, a, b in zip(prints.tolist(), first.tolist(), last.tolist())} == want
    tail = "this line is on every page of the site again"
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, "http://a.com/1", f"<body><div>{words(i)}</div><p>{tail}</p></body>") for i in range(6)] + [(9, "http://b.com/", f"<p>{tail}</p>"), (10, None, None)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: words(i) for i in range(6)} | {9: tail, 10: ""}


def test_op2_hosts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(html_text, "ARRAY_TOKENS", 50)
    test_op2_suffix_arrays(spark)


def test_op4_families(spark, docs, odd):
    model = licenses.train(docs)
    kinds = {"Apache License, Version 2.0": "apache-2.0", "GNU General Public License": "gpl", "CC BY-NC 4.0": "cc-by-nc", "MIT License": "mit", "All rights reserved": "proprietary"}
    got = {r.doc_id: r.licenses for r in licenses.scan(docs, model).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == ",".join(sorted(v for k, v in kinds.items() if k in r.text))
    for line in ("Licensed under the Elbonian Fishery license", "I lost my driving licence", "copyright is a legal term"):
        assert model.judge(line)[0] == licenses.UNKNOWN
    assert model.judge("// Redistribution and use in source and binary forms, with or without changes, are permitted provided that")[0] == "bsd"
    assert licenses.scan(odd, model).count() == odd.count() and licenses.scan(odd.limit(0)).count() == 0
    assert {r.spans for r in licenses.scan(odd.where("doc_id < 4 OR doc_id IS NULL"), model).collect()} == {""}
    # Wrapped notices behind comment marks, between other lines, in one very long line; no cue word gates them.
    for family, lines in WRAPPED.items():
        for text in ("\n".join(f" * {x}" for x in lines), "int x;\n\n// " + "\n// ".join(lines) + "\n\nreturn x;", "and the rest of it stands here. " * 400 + " ".join(lines)):
            got = model.paragraphs(text)
            assert {f for f, _, _ in got} - {licenses.UNKNOWN} == {family}, (family, got)
    slow = [(f, a, b) for t in (r.text for r in docs.limit(60).collect()) for f, a, b in brute_licenses(model, t)]
    assert slow == [x for t in (r.text for r in docs.limit(60).collect()) for x in model.paragraphs(t)]


WRAPPED = {
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public", "License, v. 2.0. If a copy of the MPL was not distributed with this", "file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "lgpl": ("This library is free software; you can redistribute it and/or", "modify it under the terms of the GNU Lesser General Public", "License as published by the Free Software Foundation; either", "version 2.1 of the License, or (at your option) any later version."),
    "gpl": ("This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."),
    "apache-2.0": ('Licensed under the Apache License, Version 2.0 (the "License");', "you may not use this file except in compliance with the License."),
    "bsd": ("Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions", "are met:"),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy", 'of this software and associated documentation files (the "Software"), to deal', "in the Software without restriction, including without limitation the rights"),
}


def brute_licenses(model, text):
    """paragraphs() by a loop over all runs of lines, each scored by its own sum of weights."""
    found = []
    for block in licenses.blocks(text):
        w = [licenses.words(text[a:b]) for a, b in block]
        for size in licenses.RUNS:
            for i in range(len(block) - size + 1):
                z, n = np.array(model.bias), 0
                flat = [(x, j) for j, line in enumerate(w) for x in line]
                at = licenses.slots([x for x, _ in flat])
                for (_, j), row in zip(flat, at):
                    if i <= j < i + size:
                        for slot in row:
                            if slot < licenses.SLOTS:
                                n += 1
                z = model.bias + sum((model.weights[s].astype(float) for (_, j), row in zip(flat, at) if i <= j < i + size for s in row), np.zeros(len(model.bias))) / np.sqrt(max(n, 1))
                p = np.exp((z - z.max()) / model.temperature)
                p /= p.sum()
                k = int(p.argmax())
                if k < len(licenses.NAMES):
                    family = licenses.NAMES[k]
                    alike = licenses.likeness([x for line in w[i : i + size] for x in line], family) if p[k] >= model.sure else 0.0
                    found.append((alike >= licenses.ALIKE, alike, p[k], -size, block[i][0], block[i + size - 1][1], family))
    out = []
    while found:
        ok, _, _, _, a, b, family = max(found, key=lambda x: (*x[:4], -x[4]))
        out.append((family if ok else licenses.UNKNOWN, a, b))
        found = [x for x in found if x[5] <= a or b <= x[4]]
    return sorted(out, key=lambda x: x[1:])


def test_op5_held_out(spark, docs, odd):
    labels = table(spark, SF, "labels")
    model = quality.train(docs, labels)
    s = quality.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in s]) > 0.97
    x = quality.features([r.text for r in docs.limit(50).collect()])
    z = np.full(50, model.base) + sum(t[np.searchsorted(e, x[:, j], "right")] for j, (e, t) in enumerate(zip(model.edges, model.tables)))
    z += sum(t[np.searchsorted(a, x[:, j], "right"), np.searchsorted(b, x[:, k], "right")] for j, k, a, b, t in model.pairs)
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-z)))
    got = quality.score(odd, model)
    assert got.count() == odd.count() and got.where("score BETWEEN 0 AND 1").count() == odd.count()
    empty = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(odd, empty).collect()} == {0.5}


def test_op9_probabilities():
    texts = ["abab abba", "abc abc cab", "zzz"]
    parts = [(np.full(len(c), i), c, n) for i, t in enumerate(texts) for c, n in [np.unique(langid.grams([t])[0], return_counts=True)]]
    m = langid.Model(["a", "b", "c"], *(np.concatenate(x) for x in zip(*parts)))
    symbols = sorted({int(c) & 0xFFFF for c in np.concatenate([p[1] for p in parts])})
    for context in ("ab", "  a", "zzz", "qqq", "cab"):
        code = 0
        for ch in context[-3:]:
            code = (code << 16 | (ord(ch) if ch != " " else 0)) & (2**48 - 1)
        p = np.exp(m._rows(4, np.array([code << 16 | s for s in symbols] + [code << 16 | 0x1234], np.uint64)))
        assert np.allclose(p.sum(0), 1, atol=1e-5)  # one symbol stands for all unseen ones


def test_op9_by_definition():
    """Interpolated Kneser-Ney by its formulas, with dictionaries over strings."""
    from collections import Counter, defaultdict

    texts = {"a": ["abab abba cab", "bab  ac"], "b": ["ccab, cbc", "cab cab cc"]}
    codes, lang = [], []
    for i, ts in enumerate(texts.values()):
        for t in ts:
            c = langid.grams([t])[0]
            codes.append(c)
            lang += [i] * len(c)
    m = langid.Model(list(texts), np.array(lang), np.concatenate(codes), np.ones(len(lang), np.int64))
    vocabulary = len({c for ts in texts.values() for t in ts for c in re.sub("[^a-z]+", " ", t)}) + 1
    for i, ts in enumerate(texts.values()):
        level = {4: Counter()}
        for t in ts:
            s = "   " + re.sub("[^a-z]+", " ", t)
            level[4].update(s[k - 3 : k + 1] for k in range(3, len(s)))
        for k in (3, 2, 1):
            level[k] = Counter(g[1:] for g in level[k + 1])

        def p(k, g):
            if k == 0:
                return 1 / vocabulary
            c, context = level[k], defaultdict(list)
            for x, n in c.items():
                context[x[:-1]].append(n)
            once, twice = (sum(n == v for n in c.values()) for v in (1, 2))
            d = min(max(once / (once + 2 * twice) if once + twice else 0.5, 0.05), 0.95)
            here = context.get(g[:-1])
            if not here:
                return p(k - 1, g[1:])
            return max(c.get(g, 0) - d, 0) / sum(here) + d * len(here) / sum(here) * p(k - 1, g[1:])

        for g in ("abab", "   a", " cab", "ccab", "bbbb", "b ac", "aacc"):
            code = 0
            for ch in g:
                code = code << 16 | (ord(ch) if ch != " " else 0)
            assert np.isclose(np.exp(m._rows(4, np.array([code], np.uint64))[0, i]), p(4, g), rtol=1e-4), (i, g)


def test_op9_grams():
    codes, ends = langid.grams(["Ab, c", "", "123", "é"])
    a, b, c, e = (ord(x) for x in "abcé")
    want = [a, a << 16 | b, (a << 32 | b << 16), (a << 48 | b << 32 | c), e]
    assert codes.tolist() == want and ends.tolist() == [4, 4, 4, 5]


def test_op9_held_out(spark, docs, odd):
    got = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert np.mean([r.rejected for r in got]) < 0.01
    model = langid.train(docs)
    o = langid.predict(odd, model)
    assert o.count() == odd.count()
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in o.where("doc_id IN (1, 2, 3)").collect())
    junk = model.predict(["qxzj kwvq zzxq jjqx wwzk qkxj vvqz xjzq wkvx zqxj qqzx", "the and of the that"])
    assert junk["rejected"].tolist() == [True, False]
    none = langid.predict(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_op10_round_trip(docs, odd):
    got = pieces.encode_documents(docs)
    assert got.where("round_trip").count() == docs.count()
    back = pieces.decode_documents(got).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id")
    assert back.where("text <> was").count() == 0
    o = pieces.encode_documents(odd)
    assert o.count() == odd.count() and o.where("NOT round_trip").count() == 0


def test_op10_is_the_library(docs):
    """The library's ids, over all texts and over random ones; and the pieces that fit are those that merging leaves alone."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r.doc_id: r.ids for r in pieces.encode_documents(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == lib.encode(r.text)
    v = pieces.Vocabulary()
    memory = pieces.Memory(v)
    rnd = random.Random(2)
    for _ in range(500):
        t = "".join(rnd.choice("abetinhrs  é日=-*\nы0x") for _ in range(rnd.randrange(0, 120)))
        assert pieces.encode(t, memory).tolist() == lib.encode(t)
        word = pieces.normalised(" " + t.replace(" ", ""))
        assert v.word(word) == [x for p in v.merged(word) for x in ([v.ids[p]] if p in v.ids else [v.bytes_at + b for b in p.encode()])]


def test_op10_chunks(docs):
    """Chunks of any size give the ids of the whole, through matrices, scans and maps alone."""
    import pandas as pd

    v = pieces.Vocabulary()
    memory = pieces.Memory(v)
    rnd = random.Random(4)
    texts = [r.text[:300] for r in docs.limit(20).collect()] + ["ab=té" * 60, "▁ x", "日本" * 20] + ["".join(rnd.choice("abte -=é") for _ in range(120)) for _ in range(20)]
    for t in texts:
        for size in (1, 2, 7, 30):
            s, chunks = " " + t, []
            for c, at in enumerate(range(0, len(s), size)):
                start = max(0, at - v.longest)
                chunks.append(type("R", (), dict(row=0, doc_id=0, chunk=c, last=at + size >= len(s), behind=at - start, n=min(size, len(s) - at), text=s[start : at + size + v.longest]))())
            run = lambda f: [f(v, r, pieces.normalised(r.text)) for r in chunks]  # noqa: E731, B023
            frame = lambda rows: pd.DataFrame(rows, columns=["row", "at", "matrix"])
            for r, e in zip(chunks, pieces._spread(frame(run(pieces._transfer)).assign(come=json.dumps([(0, pieces.START)])))["come"]):
                r.entry = e
            exits = frame(run(pieces._exits))
            back = pieces._spread(exits.assign(at=-exits["at"], come=json.dumps([pieces.END])))
            for r, leave in zip(reversed(chunks), back["come"]):
                r.leave = leave
            assert [i for x in run(pieces._trace) for i in x[3]] == pieces.encode(t, memory).tolist()
            matrices = [pieces._matrix(x[2]) for x in run(pieces._transfer)]
            if len(matrices) > 2:  # in any grouping
                k = rnd.randrange(1, len(matrices))
                assert pieces.product([pieces.product(matrices[:k]), pieces.product(matrices[k:])]) == pieces.product(matrices)


def test_op10_products_of_products(spark, monkeypatch):
    monkeypatch.setattr(pieces, "FAN", 3)
    monkeypatch.setattr(pieces, "CHUNK", 256)
    monkeypatch.setattr(pieces, "GIANT", 300)
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abetinhrs  é日=-\nы0x") for _ in range(n)) for n in (10, 300, 301, 800, 5000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    memory = pieces.Memory(pieces.Vocabulary())
    assert {r.doc_id: (r.ids, r.round_trip) for r in pieces.encode_documents(df).collect()} == {i: (pieces.encode(t, memory).tolist(), True) for i, t in enumerate(texts)}


def test_op10_giants(spark):
    text = "the quick brown fox " * 6000 + "y" * 30_000
    df = spark.createDataFrame([(1, text), (2, "short"), (None, text)], "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.encode_documents(df).collect()}
    assert all(r.round_trip for r in got.values()) and len(got) == 3
    assert got[1].ids == got[None].ids == pieces.encode(text, pieces.Memory(pieces.Vocabulary())).tolist()


def test_pipeline_stages(spark, docs):
    """Each stage against what it says: rejected documents, copies, benchmark windows and secrets are gone, the rest stays."""
    from tidewake.llm import decontaminate, secrets

    d, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        was, d = d, corpus_pipeline.keep(stage(spark, d, SF))
        sizes.append(d.count())
        if name == "language_id":
            bad = [r.doc_id for r in langid.predict(was).where("rejected").collect()]
            assert sizes[-2] - sizes[-1] == len(bad) < 15
        if name == "near_duplicates":
            assert sizes[-1] == ngram_join.classes(was).select("component_id").distinct().count()
            assert ngram_join.classes(d).where("component_id <> doc_id").count() == 0
        if name == "benchmark_decontamination":
            bench = table(spark, SF, "benchmark")
            assert sizes[-2] - sizes[-1] == decontaminate.scan(was, bench).where("contaminated").count() > 0
        if name == "secret_scan":
            assert sizes[-1] == sizes[-2]
            changed = d.join(was.select("doc_id", F.col("text").alias("t")), "doc_id").where("text <> t")
            assert changed.count() == secrets.scan(was).where("size(found) > 0").count() > 0
            assert secrets.digest(d).where("n_assign + n_access + n_hex > 0").count() == 0
        if name != "sentencepiece_encoding":
            assert d.columns == docs.columns
    assert d.where("round_trip").count() == sizes[-1] == sizes[-2]


def test_pipeline_odd_rows(spark, odd):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (plain, plain.limit(0)):
        d = rows
        for _, stage in corpus_pipeline.STAGES:
            d = corpus_pipeline.keep(stage(spark, d, SF))
        d.count()
