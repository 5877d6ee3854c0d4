import itertools
import random

import numpy as np

from corvid.llm import boilerplate as B

RAW = "page_id bigint, url string, file_path string, content string, fetched_at timestamp_ntz"


def cut_value(source, sink, edges, side):
    v = sum(sink[i] for i in range(len(side)) if side[i]) + sum(source[i] for i in range(len(side)) if not side[i])
    return v + sum(c for a, b, c in edges if side[a] != side[b])


def test_min_cut_is_minimal():
    rng = random.Random(7)
    for _ in range(40):
        n = rng.randrange(1, 8)
        source, sink = [rng.random() * 3 for _ in range(n)], [rng.random() * 3 for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.random() * 2) for _ in range(rng.randrange(0, 12))]
        best = min(cut_value(source, sink, edges, s) for s in itertools.product((False, True), repeat=n))
        assert abs(cut_value(source, sink, edges, B.max_flow_cut(n, source, sink, edges)) - best) < 1e-6


def test_grouping_changes_no_cut():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(2, 14))
        price, boxes = rng.normal(size=n) * 0.5, np.zeros(n, int)
        edges = [(i, i + 1, B.W_NEXT) for i in range(n - 1)]
        src, snk = np.maximum(price, 0).tolist(), np.maximum(-price, 0).tolist()
        whole = cut_value(src, snk, edges, B.max_flow_cut(n, src, snk, edges))
        assert abs(cut_value(src, snk, edges, B.cut_page(price, np.zeros(n, int), boxes, np.array([-1])).tolist()) - whole) < 1e-6


def test_cut_of_nested_boxes_is_minimal():
    rng = np.random.default_rng(5)
    for _ in range(60):
        n, k = int(rng.integers(1, 7)), int(rng.integers(1, 4))
        parents = np.array([-1] + [int(rng.integers(0, b)) for b in range(1, k + 1)])
        boxes, price = np.sort(rng.integers(0, k + 1, size=n)), rng.normal(size=n) * 0.3
        # the whole graph: each line to its box, each box that holds lines, or a box with lines, to the one around it
        used = set()
        for b in boxes.tolist():
            while b > 0:
                used.add(b)
                b = int(parents[b])
        hub = {b: n + i for i, b in enumerate(sorted(used))}
        edges = [(i, i + 1, B.W_NEXT if boxes[i] == boxes[i + 1] else B.W_CROSS) for i in range(n - 1)]
        edges += [(i, hub[b], B.W_BOX) for i, b in enumerate(boxes.tolist()) if b > 0]
        edges += [(hub[b], hub[parents[b]], B.W_BOX) for b in used if parents[b] > 0]
        src, snk = [*np.maximum(price, 0), *[0.0] * len(hub)], [*np.maximum(-price, 0), *[0.0] * len(hub)]
        value = lambda lines: min(cut_value(src, snk, edges, [*lines, *h]) for h in itertools.product((False, True), repeat=len(hub)))
        best = min(value(s) for s in itertools.product((False, True), repeat=n))
        assert abs(value(B.cut_page(price, np.zeros(n, int), boxes, parents).tolist()) - best) < 1e-6


def test_lines():
    page = "<html><head><title>T</title>\n<style>a{}</style>\n</head><body>\n<!-- gone\nstill gone -->\n<nav>\n<li><a href='/x'>Menu</a></li>\n</nav>\n<div class='m'>\n<header>\n<H1>T &amp; U</H1>\n</header>\n<script>var x = 'no';</script>\n<p>Body <b>text</b>.</p>\n<pre><code>\n  a: 1\n</code></pre>\n</div>\n</body></html>"
    rows, parents, body = B.visible_lines(page, "s.test")
    assert [r[0] for r in rows] == [7, 11, 14, 16]
    flags = {r[0]: r[3] for r in rows}
    assert flags[7] & B.LINK and flags[11] & B.TITLE and flags[16] & B.CODE
    assert body == 2 and [r[4] for r in rows] == [1, 3, 2, 2]
    for empty in (None, "", " \n\t"):
        assert B.visible_lines(empty)[0] == []
    md, _, body = B.visible_lines("* [Home](/)\n# Title\n```\ncode: x\n```\ntext.", "")
    assert [r[0] for r in md] == [1, 2, 4, 6] and md[0][3] & B.LINK and body == 0


def site(spark, n=60, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(3, 9)))
    sentence = lambda: " ".join(word() for _ in range(12)).capitalize() + "."
    rows, want = [], set()
    for p in range(n):
        s = f"site{p % 3}.test"
        lines = [f"<html><head><title>{word()}</title></head><body>", "<div class='a'>", "<li><a href='/h'>Home</a></li>", "<a href='/b'>Blog</a>", "<p>We store cookies here.</p>", "</div>", "<div class='b'>", "<strong>Related</strong>", f"<a href='/r'>{word()} {word()}</a>", f"<a href='/r'>{word()} {word()}</a>", "</div>", "<div class='c'>", f"<h1>{word()} {word()}</h1>"]
        first = len(lines)
        body = [f"<p>{sentence()}</p>" for _ in range(4)] + [f"<li>{word()} {word()}</li>", f"<p>{sentence()} {sentence()}</p>"]
        md = p % 10 == 9
        lines += body + ["</div>", "<div class='d'>", "<a href='/e'>Edit this page</a>", f"<p>© 20{p % 30:02} {s.split('.')[0]}</p>", "</div>", "</body></html>"]
        keep = range(first, first + len(body) + 1)
        if md:
            import re

            lines = [re.sub("<[^>]*>", "", x) if not x.startswith("<h1") else "# " + re.sub("<[^>]*>", "", x) for x in lines]
        want |= {(p, k) for k in keep}
        rows.append((p, f"https://{s}/docs/{p}", None, "\n".join(lines), None))
    return rows, want


def test_pages(spark, rows):
    data, want = site(spark)
    data += [data[0], (900, None, None, None, None), (901, "https://site0.test/x", None, "", None), (902, None, "/m/site0.test/y", "<div class='a'>\n<li><a href='/h'>Home</a></li>\n<a href='/b'>Blog</a>\n</div>", None), (None, None, None, "x", None)]
    got = set(rows(B.main_lines(spark.createDataFrame(data, RAW).selectExpr("*", "1 AS site", "2 AS seen"))))
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97
    assert not [g for g in got if g[0] >= 900]


def test_without_headings_or_rows(spark):
    df = spark.createDataFrame([(1, None, None, "Plain words without any heading, long enough to be a sentence of its own.", None)], RAW)
    assert B.main_lines(df).count() == 1
    assert B.main_lines(df.limit(0)).count() == 0


def test_bodies_and_shuffled_lines(spark, rows, monkeypatch):
    data, want = site(spark)
    df = spark.createDataFrame(data + [(900, None, None, None, None)], RAW)
    bodies = {r["page_id"]: r["body"] for r in B.main_bodies(df).collect()}
    lines = set(rows(B.main_lines(df)))
    assert bodies[900] == "" and bodies[3] == "\n".join(x for k, x in enumerate(data[3][3].split("\n"), 1) if (3, k) in lines)
    monkeypatch.setattr(B, "BROADCAST_BYTES", 0)
    assert set(rows(B.main_lines(df))) == lines
