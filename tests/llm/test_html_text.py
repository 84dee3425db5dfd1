import time

import numpy as np

from memspark.llm.html_text import KERNEL, LINKED, Page, extract_text, main_text, path_scores

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body class="no-sidebar">
<header><a href="/">Site name</a></header><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav><!-- <p>comment</p> -->
<div class="cookie-notice">We use cookies, really.</div><div class="ad">Buy this now, it is very good, and cheap, and nice.</div>
<article><h1>Head &amp; title</h1><p><b>First   sentence,
 bold.<br>Next line<p>Second &lt;paragraph&gt; with <a href="x">a link</a> inside, and caf&eacute;.</p><script>x("<p>no</p>")</script>
<form><input name=q><button>Send</button></form><ul><li>point one<li>point two, long enough</ul>
<section class="comments"><p>A reader says: nice article, thanks, very good, long text here.</p></section></article>
<aside>Related: other things, many of them, here.</aside><div id="sidebar"><p>Side text, side text, side text.</p></div>
<footer>&copy; site &middot; imprint, all of it.</footer></body></html>"""


def test_article():
    assert main_text(ARTICLE).split("\n\n") == ["Head & title", "First sentence, bold. Next line", "Second <paragraph> with a link inside, and café.", "point one", "point two, long enough"]


def test_without_article_element():
    body = "".join(f"<div class='post'><p>Paragraph {k} of the text, which is long, has commas, and goes on for a while.</p></div>" for k in range(5))
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>More</a></div><h2>A heading</h2>{body}<div class='footer'>Imprint, contact, and so on, for long.</div></body>"
    text = main_text(page)
    assert all(f"Paragraph {k}" in text for k in range(5)) and "Home" not in text and "Imprint" not in text


def test_broken_pages():
    assert main_text(None) == main_text("") == main_text("<script>never closed <p>x</p>") == main_text("<p></p>") == ""
    assert main_text("<") == "<"
    assert main_text("plain text, no tags") == "plain text, no tags"
    assert main_text("<article><p>cut &amp; off &am") == "cut & off &am"
    assert main_text("<article><p>text<!-- open <p>gone") == "text"
    assert main_text("</div></p><article><p>a<div>b</p></span>c</div></article></body>") == "a\n\nb\n\nc"
    assert main_text("<article><p title='a > b'>x</p><p title=\"unclosed>y</p></article>").startswith("x")


def test_depth_and_length():
    assert main_text("<article>" + "<div>" * 20000 + "deep" + "</div>" * 20000 + "</article>") == "deep"
    assert main_text("<article><p>" + "word, " * 100000 + "</p></article>") == ("word, " * 100000).strip()
    assert len(Page("<p>x</p>" * 5000).blocks) == 5000
    assert main_text("<article>" + "<p>x" * 30000) == "\n\n".join("x" * 30000)


def test_rows(spark):
    rows = [(1, "u", ARTICLE, "clash"), (1, "u", ARTICLE, "clash"), (2, None, None, ""), (None, "v", "<p>é only</p>", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract_text(df).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert sorted(r.text for r in got)[0] == "" and "é only" in {r.text for r in got}
    assert extract_text(df.limit(0)).count() == 0


def plain_scores(page):
    """path_scores, by plain loops over blocks and paths."""
    free = lambda t, k: len(t) - min(k, len(t))

    def length(p):
        own = [len(t) for t, q, _ in page.blocks if q == p]
        return sum(own) / len(own)

    def marks(p):
        own = [sum(c in ".,;:!?…。、，！？" for c in t) for t, q, _ in page.blocks if q == p]
        return sum(own) / len(own) + 1

    def smoothed(i, ratio):
        near = [(KERNEL[abs(i - j)], q) for j, (_, q, _) in enumerate(page.blocks) if abs(i - j) < len(KERNEL) and page.parent[q] == page.parent[page.blocks[i][1]]]
        return sum(w * ratio(q) for w, q in near) / sum(w for w, _ in near)

    def fused(p):
        own = [[smoothed(i, ratio) for i, (_, q, _) in enumerate(page.blocks) if q == p] for ratio in (length, marks)]
        return (sum(own[0]) * sum(own[1])) ** 0.5 / len(own[0])

    def above(p):
        return [p, *above(page.parent[p])] if p > 0 else [0]

    def below(p):
        return [(free(t, k) * (sum(c in ".,;:!?…。、，！？" for c in t) + 1)) ** 0.5 * page.prior[q] for t, q, k in page.blocks if p in above(q)]

    dense = {p: sum(below(p)) * (sum(below(p)) / max(1, len(below(p)))) ** 2 for p in sorted({max(q, 0) for q in page.parent})}
    main = max(dense, key=lambda p: (round(dense[p], 6), -p))

    def inside(p):
        whole = max(sum(below(0)), 1e-9)
        if main in above(p):
            return 1.0
        if p in above(main):
            return (sum(below(p)) - sum(sum(below(q)) for q in range(1, len(page.parent)) if page.parent[q] == p)) / whole
        return max(sum(below(q)) for q in above(p) if q not in above(main)) / whole

    linked = lambda p: sum(min(k, len(t)) for t, q, k in page.blocks if q == p) / max(1, sum(len(t) for t, q, _ in page.blocks if q == p))
    return {p: fused(p) * (1 - (LINKED if page.inside[p] else 1) * linked(p)) * page.prior[p] * inside(p) ** 2 for _, p, _ in page.blocks}


def test_scores_equal_brute_force():
    import random

    rng = random.Random(4)
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 30)):
            words = ", ".join("word" * rng.randint(1, 9) for _ in range(rng.randint(0, 8)))
            parts.append(rng.choice(["<div>", "</div>", "<section class='x'>", "</section>", "<ul>", "</ul>", "<nav>", "</nav>", "<div class='comment-list'>"]))
            parts.append(rng.choice(["<p>{}</p>", "<li>{}", "<h2>{}</h2>", "<p><a href=1>{}</a> more", "{}"]).format(words))
        page = Page("".join(parts))
        if page.blocks:
            score, want = path_scores(page), plain_scores(page)
            assert all(abs(score[p] - v) <= 1e-9 * max(1, v) for p, v in want.items())


def test_long_hostile_markup_is_read_in_linear_time():
    def seconds(n):
        began = time.perf_counter()
        main_text("<div>" * n + "</section>" * n)
        main_text("<section><article>" + "<div>" * n + "</section>" * n + "<li></li>" * n)
        return time.perf_counter() - began

    assert seconds(64_000) < 20 * max(0.05, min(seconds(8000) for _ in range(3)))


def without_hints(monkeypatch):
    from memspark.llm import html_text

    for name in ("NAMED", "NAMED_WHOLE", "OTHER"):
        monkeypatch.setattr(html_text, name, frozenset())


def test_ratios_alone_find_most_articles(monkeypatch):
    """Without names and tags as hints, ratios and links give the article's text on 95 % of the given pages; without ratios on none."""
    import duckdb

    from memspark.llm import html_text

    pages = [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    want = [main_text(h) for h in pages]
    without_hints(monkeypatch)
    assert sum(main_text(h) == w for h, w in zip(pages, want, strict=True)) >= 0.95 * len(pages)
    monkeypatch.setattr(html_text, "path_scores", lambda page: np.ones(len(page.parent)))
    assert not any(main_text(h) == w for h, w in zip(pages, want, strict=True))


def test_ratios_find_the_article_without_any_hint(monkeypatch):
    without_hints(monkeypatch)
    own = [f"Paragraph {k} of the article, which goes on for a while, as such paragraphs do; it has commas, and more." for k in range(8)]
    other = ["<div><ul><li><a href=1>Menu one</a><li><a href=2>Menu two</a></ul></div>", "<div>We use cookies, really.</div>", "<div>Buy this now, it is good.</div>"]
    last = ["<div><p>Related: other things, many of them.</p></div>", "<div>&copy; site, imprint, all of it.</div>"]
    for wrapped in ("{}", "<div id=x>{}</div>"):
        page = wrapped.format("".join([*other, "<div><h1>Head of it</h1>", *(f"<p>{t}" for t in own[:4]), "<div><ul><li>a point</ul>", *(f"<p>{t}" for t in own[4:]), "</div></div>", *last]))
        assert main_text(page).split("\n\n") == ["Head of it", *own[:4], "a point", *own[4:]]


def test_long_attributes_and_names():
    assert main_text(f"<article><p>Some text, here.<img alt='{'a>' * 6000}'><p data-x=\"{'<b>' * 9000}\">More text, here.</article>") == "Some text, here.\n\nMore text, here."
    assert main_text("<div class='table-responsive shared-content'><p>Some text, and more of it.</p></div>") == "Some text, and more of it."
    assert main_text("<article><ul><li><a href=1>All of it linked</a></ul><p>Some text, and more.</article>") == "All of it linked\n\nSome text, and more."
