import collections
import random
import re

import pytest

from sequor.llm import html_extract


def extracted(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.extract(pages).collect()}


def test_templates_of_a_section_or_of_a_small_share_go(spark):
    page = lambda i, more: f"<body><div>Text {i} of its own</div>{more}</body>"
    rows = [(i, f"http://h.com/{'news' if i < 8 else 'shop'}/{i}", page(i, "<div>Sidebar of news</div>" if i < 8 else "<div>Notice</div>" if i % 10 == 0 else "")) for i in range(300)]
    assert extracted(spark, rows) == {i: f"Text {i} of its own" for i in range(300)}


def test_blocks_of_an_article_that_recur_go_and_copied_articles_stay(spark):
    recurring = "<ul><li>Read more</li></ul><h2>Our offers</h2><figure>Logo</figure><p>Write to us</p>"
    rows = [(i, f"http://h.com/{i}", f"<article><p>Own {i}</p>{recurring}</article>") for i in range(12)]
    rows += [(100 + i, f"http://h.com/c{i}", "<article><p>A copied text</p><p>and its second part</p></article>") for i in range(9)]
    got = extracted(spark, rows)
    assert all(got[i] == f"Own {i}" for i in range(12))
    assert all(got[100 + i] == "A copied text\nand its second part" for i in range(9))


@pytest.mark.parametrize(
    "html, want",
    [
        ('<div class="content has-sidebar"><p>a</p></div><div class="sidebar">s</div>', ["a"]),
        ('<div class="post search-friendly"><p class="no-ads">a</p><p class="ad-slot">b</p></div>', ["a"]),
        ("<p>x <math><mi>y</mi></math> <svg><text>z</text></svg> <object>o</object></p>", ["x y z o"]),
        ("<form id=aspnet><div class=modal><article><p>a</p><form>f</form></article></div><p>s</p></form>", ["a"]),
    ],
)
def test_content_stays(html, want):
    assert html_extract.parse(html)[0] == want


def test_deep_and_long_pages_are_linear():
    deep = "<div>" * 50_000 + "<p>in</p>" + "</div>" * 50_000
    blocks, subtrees = html_extract.parse(deep)
    assert blocks == ["in"] and len(subtrees) == 50_001
    long_ = "".join(f"<p>text {i}</p>" for i in range(100_000))
    assert len(html_extract.parse(long_)[0]) == 100_000


def brute(rows, min_pages=5, share=0.3):
    """Templates by plain counting over all pages."""
    parsed = [(i, u, *html_extract.parse(h or "")) for i, u, h in rows]
    place = lambda u: (re.sub(r"^.*?://([^/?#]*).*$", r"\1", u or "") if "://" in (u or "") else "", (re.findall(r"^[^:/?#]+://[^/?#]*/([^/?#]+)/", u or "") or [""])[0])
    first = {}
    for i, u, b, s in sorted(parsed, key=lambda x: str(x[0])):
        text = "\n".join(b)
        if not any(k[0] == place(u)[0] and (k[1] == u or k[2] == text) for k in first):
            first[(place(u)[0], u, text)] = (place(u), {(h, x) for h, _, _, x in s})
    gone = set()
    for level in (lambda p: p[:1], lambda p: p):
        n, of = collections.Counter(), collections.Counter(level(p) for p, _ in first.values())
        for p, s in first.values():
            n.update((level(p), *x) for x in s)
        gone |= {k for k, c in n.items() if c >= min_pages and c >= (max(html_extract.INSIDE_PAGES, of[k[0]] * html_extract.INSIDE_SHARE) if k[2] else min(of[k[0]] * share, of[k[0]] ** 0.5))}
    out = {}
    for i, u, b, s in parsed:
        hit = [x for x in s if any((level, x[0], x[3]) in gone for level in (place(u)[:1], place(u)))]
        left = [t for j, t in enumerate(b) if not any(f <= j < e for _, f, e, _ in hit)]
        out[i] = "\n".join(left or b), len({h for h, *_ in hit})
    return out


@pytest.mark.parametrize("limit", [0, 4_000_000])
def test_whole_result_equals_plain_counting(spark, sf_dir, monkeypatch, limit):
    monkeypatch.setattr(html_extract, "BROADCAST_TEMPLATES", limit)
    rng = random.Random(5)
    parts = ["<div>Notice of the site</div>", "<p>Share it</p>", "<nav><ul><li>Home</li><li>About</li></ul></nav>", "<section><p>Offers</p><p>More</p></section>", ""]
    rows = [(i, f"http://{rng.choice(['a.com', 'B.com'])}/{rng.choice(['x', 'y', 'z'])}/{i}", f"<body>{rng.choice(parts)}<article><p>Own text {i}</p>{rng.choice(parts)}</article>{rng.choice(parts)}</body>") for i in range(120)]
    rows += [(200 + i, u, h) for i, (_, u, h) in enumerate(rows[:7])] + [(300, None, None), (301, "", "<p>a"), (302, "x", ""), (303, None, "<p>a")]
    want = brute(rows)
    table = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_templates) for r in html_extract.extract(table).collect()}
    assert {i: t for i, (t, _) in got.items()} == {i: t for i, (t, _) in want.items()}
    assert sum(n > 0 for _, n in got.values()) > 60


def test_templates_decide_rows_of_the_tables(spark):
    """The share of pages on which recurring subtrees were found, over the whole table."""
    rows = html_extract.extract(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).select("n_templates").collect()
    share = sum(r.n_templates > 0 for r in rows) / len(rows)
    print(f"pages with templates: {share:.3f}")
    assert share > 0


def test_names_do_not_take_what_articles_say():
    from sequor.llm.html_extract import parse

    texts = lambda page: [b for b in parse(page)[0]]
    told = lambda page: [b[0] if isinstance(b, tuple) else b for b in texts(page)]
    assert told('<article><p>One.</p><div class="related-work"><p>Earlier papers.</p></div><p class="search">How to search.</p></article>') == ["One.", "Earlier papers.", "How to search."]
    assert told('<div role="main"><p>One.</p><div class="widget"><p>A widget is a part.</p></div></div>') == ["One.", "A widget is a part."]
    assert told('<section id="comments-policy"><h1>Policy</h1><p>All comments are read.</p></section>') == ["Policy", "All comments are read."]
    # comments, adverts and calls in articles are named as wholes, and go
    assert told('<article><p>One.</p><div class="comments"><p>First!</p></div><div class="ad">Buy.</div><div class="comment-list">x</div><div id="ad-slot-3">y</div></article>') == ["One."]
    assert told('<div class="sidebar-left">x</div><div class="cookie-bar">y</div><div class="related-posts"><a href="/">z</a></div><p>Text.</p>') == ["Text."]
