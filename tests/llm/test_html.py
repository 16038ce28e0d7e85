"""HTML extraction against pages whose article is known, a plain form of its rule and odd input."""

import html
import random
import re
import time

import pytest

pytest.importorskip("spanforge.llm")

from pyspark.sql import functions as F  # noqa: E402

from spanforge.llm import html_text  # noqa: E402

def test_html():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li>Home</li></ul></nav><div class="ad">Buy now</div><article><h1>A title</h1><p>One&nbsp;&amp; two
    lines<br>and <b>bold</b> end.</p><p>&#8364; &lt;tag&gt;</p><aside>no</aside></article><div id="comments"><p>reader says</p></div><footer>&copy; x</footer></body></html>"""
    assert html_text.main_text(page) == "A title One & two lines and bold end. € <tag>"
    plain = "<body><div>Menu</div><p>" + "A long enough paragraph of the article. " * 3 + "</p><p>" + "And a second paragraph that goes on. " * 3 + "</p><div class='sidebar'><p>" + "side " * 50 + "</p></div></body>"
    assert html_text.main_text(plain).endswith("goes on.") and "side" not in html_text.main_text(plain)
    for odd in (None, "", "<", "<p", "&", "&am", "<!--", "<article>", "<script>x", "a<b", "<p>x<div class=", "</p></p>"):
        assert isinstance(html_text.main_text(odd), str)
    assert html_text.main_text("<article><p>cut of&am") == "cut of&am"


def test_html_pages(spark, sf_dir):
    out = html_text.query(spark, sf_dir).collect()
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in out:
        body = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)[^>]*>", body)]
        assert r.text == " ".join(b for b in blocks if b) and r.n_chars == len(r.text)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(empty).count() == 0


def paragraph(rng, n):
    words = [f"w{rng.randrange(5000)}" for _ in range(n)]
    return " ".join(words)


def menu(rng):
    return "<ul>" + "".join(f'<li><a href="/m{i}">menu {i}</a></li>' for i in range(rng.randrange(3, 7))) + "</ul>"


CHROME = [
    lambda rng: f"<nav>{menu(rng)}</nav>",
    lambda rng: f'<div class="ad-box"><p>{paragraph(rng, 30)}</p></div>',
    lambda rng: f'<aside><h2>Aside</h2><p>{paragraph(rng, 40)}</p></aside>',
    lambda rng: f'<div class="cookie-notice">{paragraph(rng, 25)}</div>',
    lambda rng: f'<section id="comments"><article><p>{paragraph(rng, 35)}</p></article></section>',
    lambda rng: f'<form><p>{paragraph(rng, 20)}</p><input name="q"></form>',
    lambda rng: f'<ul class="share links">{menu(rng)}</ul>',
    lambda rng: menu(rng),
    lambda rng: f"<script>var x = '<p>{paragraph(rng, 9)}</p>';</script><style>p{{}}</style>",
]


def page(rng, marked):
    """A page and its article's text: chrome around and inside, long and short blocks."""
    blocks, want = [], []
    for i in range(rng.randrange(3, 12)):
        if i and rng.random() < 0.3:
            blocks += [rng.choice(CHROME)(rng) for _ in range(rng.randrange(1, 3))]
        text = paragraph(rng, rng.choice([2, 3, 12, 60]) if i > 1 else 40)
        at = rng.randrange(len(text.split()))
        shown = " ".join(f"<b>{w}</b>" if k == at else w for k, w in enumerate(text.split()))
        blocks.append(rng.choice(["<p>{}</p>", "<p class='share-price'>{}</p>", "<p>{}"]).format(shown.replace(" ", "\n ", 1)))
        want.append(text)
    head = "A title" if rng.random() < 0.7 else ""
    if head:
        blocks.insert(0, f"<header><h1>{head}</h1></header>" if marked and rng.random() < 0.3 else f"<h1>{head}</h1>")
        want.insert(0, head)
    box = rng.choice(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>"]) if marked else "<div id='content'>{}</div>"
    around = lambda: "".join(rng.choice(CHROME)(rng) for _ in range(rng.randrange(3)))
    teaser = "<article><h2>Other</h2><p>Read on there.</p></article>" if marked and rng.random() < 0.3 else ""
    return f"<html><head><title>x</title></head><body>{around()}{box.format(''.join(blocks))}{teaser}{around()}<footer><p>&copy; me</p></footer></body></html>", " ".join(want)


@pytest.mark.parametrize("marked", [True, False])
def test_articles_are_found_whole(marked):
    rng = random.Random(marked)
    for _ in range(400):
        source, want = page(rng, marked)
        assert html_text.main_text(source) == want, source


def test_runs_equal_plain_form():
    """A run begins where a window first comes to ``least`` and ends where one is empty."""
    rng = random.Random(6)
    for _ in range(500):
        sizes = [rng.choice([0, 0, 0, 3, 20, 50, 200]) for _ in range(rng.randrange(30))]
        width, least = rng.randrange(1, 5), rng.choice([1, 40, 100])
        want, inside = [], False
        for i in range(len(sizes)):
            total = sum(sizes[i : i + width])
            if not inside and total >= least:
                want.append([i, len(sizes)])
                inside = True
            elif inside and total == 0:
                want[-1][1] = i
                inside = False
        assert html_text.runs_of(sizes, width, least) == [tuple(r) for r in want]


def test_page_parts():
    long = "A long enough sentence of the article. " * 3
    for inside in ("<p class='share-price'>{}</p>", "<p class='ad-hoc'>{}</p>", "<div id='social-policy'>{}</div>", "<div class='has-sidebar'><p>{}</p></div>"):
        assert html_text.main_text(f"<body><article><header><h1>T</h1></header>{inside.format(long)}</article></body>") == f"T {long.strip()}"
    for outside in ("site-footer", "comments", "ad-slot", "newsletter signup", "related-posts", "top-nav"):
        assert html_text.main_text(f"<article><p>{long}</p><div class='{outside}'><p>{long}</p></div></article>") == long.strip()
    assert html_text.main_text(f"<html><head><title>T</title><body><p>{long}") == long.strip()
    assert html_text.main_text(f'<p class="x>{long}</p><p>{long}</p>') == f"{long}{long.strip()}"  # the quote has no end: it counts for nothing
    assert html_text.main_text(f"<p>{long}<button>Press</button> on</p>") == f"{long}on"


@pytest.mark.parametrize("piece", ['<a "', "<div>", "<svg>", "<script>", "<!--", "<p class='", "<![CDATA[", "</p>", "<p>x", "&am", "<li><a href=x>y"])
def test_time_is_linear_in_the_page(piece):
    began = time.process_time()
    html_text.main_text(piece * (400_000 // len(piece)))
    assert time.process_time() - began < 8


def test_html_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "v", "<p>hello"), (4, "w", "<p>" + "x" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("no")).withColumn("n_chars", F.lit(0))
    out = html_text.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r.page_id or 0, r.n_chars) for r in out.collect())) == [(0, 5), (1, 0), (1, 0), (2, 0), (4, 300_000)]
