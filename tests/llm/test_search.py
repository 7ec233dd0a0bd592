"""HTML extraction, URL rules, nearest neighbours."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from footmark.llm import html, neighbours, urlfilter


# --- pages ---
PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{{}}</style></head><body>
<header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<aside>About us and our sidebar text</aside><div class="cookie-notice">We use cookies on this long page of ours</div>
{open}<h1>Head&amp;line</h1><p>First <b>paragraph &lt;x&gt; with   enough
words to be dense and long, one after another.<br>Next line.<p>Short.<p>A last paragraph with many words that goes on for quite some time.{close}
<form><label>Name</label><input name=x><button>Send</button></form><section id="comments"><p>Reader comment that is as long as any
paragraph of the article itself.</p></section><script>var t="</p>";</script><footer>&copy; 2020 all rights reserved by the site</footer></body></html>"""
TEXT = ("Head&line\nFirst paragraph <x> with enough words to be dense and long, one after another. Next line.\nShort.\n"
        "A last paragraph with many words that goes on for quite some time.")


@pytest.mark.parametrize("open_,close", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class=post-content>", "</div>"), ("<div>", "</div>")])
def test_article(open_, close):
    assert html.main_text(PAGE.format(open=open_, close=close)) == TEXT


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("just text", "just text"), ("<p>one<p>two", "one\ntwo"), ("<nav>menu</nav>", ""),
    ("<![foo[<p>x</p>", None), ("<p>a &amp; b &#233; &nbsp; c</p>", "a & b é c"), ("</div></p><p>stray</p></article>", "stray"),
    ("<article><header><h2>Head</h2><p>by me</p></header><p>Body text</p></article>", "Head\nBody text"), ("<p>cut off <b", None)])
def test_odd_pages(page, text):
    found = html.main_text(page)
    assert text is None or found == text


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE.format(open="<article>", close="</article>")), (None, None, None), (1, "u", "<p>é</p>")],
                                  "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = sorted((r.page_id or 0, r.n_chars, r.text) for r in html.extract_pages(pages).collect())
    assert rows == [(0, 0, ""), (1, 1, "é"), (1, len(TEXT), TEXT)]
    assert html.extract_pages(pages.limit(0)).isEmpty()


# --- urls ---
def judged_by_brute_force(url, rules, default):
    at = url.find("://") if url is not None else -1
    rest = url[at + 3:] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules
           if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[4]) if fit else (host, path, None, default)


URLS = [None, "", "no scheme", "http://", "http://COM", "http://com/", "https://a.example.com/en/x?q#f", "http://www.EXAMPLE.com/en/", "http://www.example.com/enx",
        "x://net/es/1", "x://a.net/fr/", "x://anet/fr/", "http://example.com.", "http://example.com?x=/en/", "http://ünï.com/É", "http://a..com/", "a://b://com/"]


@pytest.mark.parametrize("block", [100, 1, 3])
def test_rules(spark, block):
    rng = random.Random(4)
    hosts = ["com", "example.com", "www.example.com", "net", "a.net", "example.com.net", "", "com.com"]
    rules = [(rng.choice(hosts), rng.choice(["/", "", "/en/", "/e", "/en/x"]), rng.choice(["allow", "block"])) for _ in range(25)] + [(None, "/", "block"), ("net", None, "block")]
    urls = URLS + [f"http://{rng.choice(['', 'x.', 'www.'])}{rng.choice(hosts)}{rng.choice(['/', '', '/en/y', '/en', '/en/x/'])}" for _ in range(150)]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://com/"), (0, None)], "page_id long, url string").withColumn("rule", F.lit("clash")).repartition(4)
    found = urlfilter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), "allow", block)
    want = [(i, *judged_by_brute_force(u, rules, "allow")) for i, u in [*enumerate(urls), (None, "http://com/"), (0, None)]]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)


def test_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [tuple(r) for r in urlfilter.judge_urls(pages, none, "block").collect()] == [(1, "a", "/", None, "block")]
    assert urlfilter.judge_urls(pages.limit(0), none).isEmpty()


# --- neighbours ---
def vectors(n=700, dims=8):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=dims) * rng.uniform(0.5, 2)).astype("float32").tolist(), 0) for i in range(n)]
    same = rng.normal(size=dims).astype("float32").tolist()
    rows += [(n + i, same, 0) for i in range(300)]
    return rows + [(2000, None, 0), (2001, [0.0] * dims, 0), (2020, [float("nan")] * dims, 0), (2040, [None] * dims, 0), (2060, [], 0), (2061, [float("inf")] * dims, 0),
                   (None, same, 0), (2080, [1.0, 2.0], 0), (2081, [3.0, 1.0], 0), (40, [9.0] * dims, 0), rows[20], rows[20]]


def nearest_by_brute_force(rows, k):
    best = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            best[i, len(v)] = min(best.get((i, len(v)), v), v)
    out = []
    for (q, n), v in best.items():
        if q % 20 == 0:
            scores = []
            for (c, m), w in best.items():
                if c != q and m == n:
                    total = 0.0
                    for a, b in zip(v, w):
                        total += float(a) * float(b)
                    scores.append((-total, c))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def test_exact_neighbours(spark):
    rows = vectors()
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    found = neighbours.nearest(given, F.col("vec_id") % 20 == 0, per_shard=300)
    assert sorted(map(tuple, found.collect())) == nearest_by_brute_force(rows, 20)


def test_relaxed_search_finds_most(spark):
    rows = vectors()
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {(r.query_id, r.vec_id) for r in neighbours.nearest(given, F.col("vec_id") % 20 == 0, factor=0.8).collect()}
    want = {(q, c) for q, _, c, _ in nearest_by_brute_force(rows, 20)}
    assert len(found & want) >= 0.9 * len(want)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(none, F.col("vec_id") % 20 == 0).isEmpty()
