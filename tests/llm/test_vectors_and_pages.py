"""Vectors, pages and URLs against brute force."""

import html
import re

import numpy as np
import pytest

from weftline.llm import embedding_dedup, linking, queries, site_tree, url_rules


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 16))
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 3)) for i, v in enumerate(base)]
    for i in range(60):
        v = base[i % 30] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3])
        rows.append((100 + i, [float(np.float32(x)) for x in v], int(i % 30 % 3)))
    rows += [(200 + k, rows[4][1], rows[4][2]) for k in range(20)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] + [1.0] * 15, 1), (303, [None] + [1.0] * 15, 1), (304, rows[4][1], None), (305, [float("inf")] * 16, 0), (306, [], 0), (307, rows[4][1][:8], rows[4][2]), (None, rows[4][1], rows[4][2]), (4, rows[4][1], rows[4][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    n = len(rows)

    def usable(i, v, label):
        return i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(a):
            if usable(*rows[a]) and usable(*rows[b]) and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(r[1], np.float32).astype(float) for r in (rows[a], rows[b]))
                links[a, b] = links[b, a] = x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93
    label = [r[0] for r in rows]
    for _ in range(n):
        label = [label[a] if label[a] is None else min([label[a], *(label[b] for b in np.flatnonzero(links[a]))]) for a in range(n)]
    want = sorted(((rows[a][0], int(links[a].sum()), label[a], rows[a][0] is not None and rows[a][0] == label[a]) for a in range(n)), key=str)
    got = sorted((tuple(r) for r in embedding_dedup.embedding_dedup(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == want
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embedding_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.ones(8) + rng.normal(size=8) * 0.01], 0) for i in range(30)]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(29, 0)}


def test_components(spark):
    import random

    rng = random.Random(0)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(500 + k, 501 + k) for k in range(40)] + [(700, 700 + k) for k in range(1, 50)]
    got = {r["id"]: r["component"] for r in linking.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in range(300):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {x: c for x, c in label.items() if any(x in p and p[0] != p[1] for p in pairs)}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head><body class="page">
<nav><ul><li><a href="/x">menu</a></ul></nav><div class="ad">advert</div><!-- <p>gone</p> --><div id="cookie-notice">cookies</div>
<article><header><h1>Big &amp; bold</h1></header><p>One <b>t</b>wo&nbsp;three<br>four<p>Five &lt;six&gt;<ul><li>a<li>b</ul>
<form><input name=q><button>go</button></form><div class="comments"><p>reader</p></div><aside>side</aside></article><footer>&copy; foot</footer></body></html>"""


def test_page_by_hand(spark):
    rows = [(1, "http://a.example/x", PAGE), (2, "http://a.example/y", None), (3, None, ""), (4, "nope", "<p>just text"), (5, "http://b.example/", "<body><header>h</header><p>body <i>text</i></p><footer>f</footer>"), (5, "http://b.example/", "<article><p>cut &am"), (6, "http://a.example/z", "plain < 3 words")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, text int")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in site_tree.extract_text(df).collect())
    texts = [(1, "Big & bold One two three four Five <six> a b"), (2, ""), (3, ""), (4, "just text"), (5, "body text"), (5, "cut &am"), (6, "plain < 3 words")]
    assert got == [(i, t, len(t)) for i, t in texts]
    assert site_tree.extract_text(df.limit(0)).count() == 0


def test_style_nodes_that_do_not_vary_are_removed(spark):
    rows = [(k, f"http://one.example/{k}", f"<body><div class=box>Always the same line</div><div class=story><p>Story number {k} is new</p></div></body>") for k in range(20)]
    got = {r["text"] for r in site_tree.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {f"Story number {k} is new" for k in range(20)}
    few = {r["text"] for r in site_tree.extract_text(spark.createDataFrame(rows[:3], "page_id long, url string, html string")).collect()}
    assert few == {f"Always the same line Story number {k} is new" for k in range(3)}


def test_the_tree_alone_removes_what_no_name_tells(spark):
    """Unnamed menus of a host, among them one that is on a few pages only, fall by counts; the same pages stay whole without the tree."""
    menu = lambda k: f"<div><span>Menu {k % 3}</span></div>" if k % 9 else "<div><p>Rare menu</p></div>"
    rows = [(k, f"http://two.example/{k}", f"<body>{menu(k)}<section><p>Text {k} of its own, long enough to count</p></section></body>") for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    alone = {r["page_id"]: r["text"] for r in site_tree.extract_text(df, markup=False).collect()}
    assert alone == {k: f"Text {k} of its own, long enough to count" for k in range(40)}
    off = {r["page_id"]: r["text"] for r in site_tree.extract_text(df, markup=False, low=0.0).collect()}
    assert all(off[k] != alone[k] and off[k].endswith(alone[k]) for k in range(40))


def test_vectors_of_extreme_size(spark):
    """Squares that overflow or vanish, and components of either zero."""
    rows = [(1, [1e200, 1e200], 1), (2, [2e200, 2e200], 1), (3, [1e-200, 1e-200], 1), (4, [5e-324, 5e-324], 1), (5, [-0.0, 1.0], 2), (6, [0.0, 1.0], 2), (7, [-0.0, 2.0], 2)]
    got = sorted(tuple(r) for r in embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 3, 1, False), (5, 2, 5, True), (6, 2, 5, False), (7, 2, 5, False)]


def test_pages_of_the_test_data(spark, sf):
    pages = {r["page_id"]: r["html"] for r in queries.table(spark, sf, "pages").collect()}
    for r in queries.op4_html(spark, sf).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S).group(1)
        text = re.sub(r"<[^>]*(>|$)", "", re.sub(r"</?(h1|p|br)[^>]*>", " ", body))
        assert r["text"] == re.sub(r"\s+", " ", html.unescape(text)).strip()


URLS = [
    ("https://WWW.a.net/x", "www.a.net", "/x", "net/", "block"),
    ("https://example.net/en/1", "example.net", "/en/1", "example.net/en/", "allow"),
    ("https://sub.example.net/en/1?q#f", "sub.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
    ("http://m.example.com/de/9", "m.example.com", "/de/9", "example.com/de/", "block"),
    ("http://example.org/fr/", "example.org", "/fr/", "org/fr/", "allow"),
    ("http://example.net", "example.net", "", None, "allow"),
    ("http://example.net?x=/en/", "example.net", "", None, "allow"),
    ("http://ÄB.com/p", "Äb.com", "/p", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(k, u[0], "x") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, verdict string")
    got = [tuple(r) for r in url_rules.judge_urls(df, none).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    assert got == [u[1:] for u in URLS]
    assert url_rules.judge_urls(df.limit(0), none).count() == 0


def test_mined_rules(spark):
    seen = [(f"http://h{k}.spam-farm.org/en/{k}", "block") for k in range(40)] + [(f"http://h{k}.good.org/en/{k}", "allow") for k in range(60)] + [(None, "block"), ("http://x.org/", None)]
    labelled = spark.createDataFrame(seen, "url string, verdict string")
    rules = url_rules.mine_rules(labelled, 0.05, 0.9)
    assert (("h:spam",), "block", 1.0, pytest.approx(0.4)) in rules and not any(len(r[0]) > 1 and "h:spam" in r[0] for r in rules)
    df = spark.createDataFrame([(1, "http://new.spam-farm.org/de/7"), (2, "http://new.good.org/de/7"), (3, "http://else.com/")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge_urls(df, labelled, rules=(), min_support=0.05, min_confidence=0.9).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}


def test_copies_of_an_article_stay(spark):
    def page(k, story):
        return f"<body><ul class=tabs><li>Tab {k}</ul><article><p>{story}</p></article></body>"

    rows = [(k, f"http://one.example/{k}", page(k, "The story that all carry" if k < 19 else "A story of its own")) for k in range(20)]
    got = {r["page_id"]: r["text"] for r in site_tree.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "The story that all carry" if k < 19 else "A story of its own" for k in range(20)}
    # near copies too: every page has a different date line
    rows = [(k, f"http://one.example/{k}", f"<body><article><h1>Day {k}</h1><p>{'The same' if k < 19 else 'Another'} story</p></article></body>") for k in range(20)]
    got = {r["page_id"]: r["text"] for r in site_tree.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Day {k} {'The same' if k < 19 else 'Another'} story" for k in range(20)}


def test_negative_zero_is_zero(spark):
    df = spark.createDataFrame([(1, [1.0, -0.0], "a"), (2, [1.0, 0.0], "a"), (3, [1.0, 0.01], "a"), (4, [-0.0, 1.0], "a")], "vec_id long, embedding array<double>, label string")
    got = sorted(tuple(r) for r in embedding_dedup.embedding_dedup(df).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]
