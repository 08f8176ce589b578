import time

from quillsieve.llm import html_text as h

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>'
    '<div class="ad">Buy this.</div><article><h1>A head &amp;amp; more</h1><p><b>One\n two&nbsp;three<br>four<p>Five<span> six</span></p>'
    '<aside>left out</aside><div class="comments"><p>I think so too and say it in very many words indeed</p></div><p>Last.</p></article><footer>&copy; x</footer>'
)


def test_article_of_a_page():
    assert h.main_text(PAGE) == "A head &amp; more\n\nOne two three four\n\nFive six\n\nLast."
    assert h.main_text(PAGE[: PAGE.index("Last")]) == "A head &amp; more\n\nOne two three four\n\nFive six"


def test_page_without_article_element():
    page = '<body><div class="menu"><a>a</a> <a>b</a></div><div class="with-sidebar"><h2>Head</h2><p>Some words that make a text of it.</p><p>Short.</p></div><div class="sidebar">not this one</div>'
    assert h.main_text(page) == "Head\n\nSome words that make a text of it.\n\nShort."


def test_labelled_pages_give_their_articles():
    import re

    for page, a, b in h.labelled_pages():
        want = [" ".join(re.sub("<[^>]*>", "", x).split()) for x in re.split(r"</?(?:h1|p|ul|li|div|article|main)\b[^>]*>", page[a:b].replace("<br>", " "))]
        assert h.main_text(page) == "\n\n".join(x for x in want if x)


def test_best_region_is_the_largest_sum():
    import random

    rng = random.Random(1)
    for _ in range(300):
        s = [rng.randint(-4, 4) for _ in range(rng.randint(0, 12))]
        a, b = h.best_region(s)
        assert sum(s[a:b]) == max([0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1))])


def test_odd_input_and_long_input():
    for page in ("", None, "<a", "<!-- never", "<article></article><footer>c d e</footer>", "<script>x", "<>"):
        assert h.main_text(page) in ("", "<>")
    for part in ("<", "<p ", "<div>", "</div>", "<a href='", "&amp;", "<!--", "<script>", '<p title="', "<section></div>"):
        began = time.time()
        h.main_text(part * 20_000)
        assert time.time() - began < 10, part


def test_table(spark):
    rows = [(1, "u", PAGE, "t"), (2, None, None, "t"), (3, "v", "", "t"), (1, "u", PAGE, "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["url"], r["n_chars"]) for r in h.extract(frame).collect())
    n = len(h.main_text(PAGE))
    assert got == [(1, "u", n), (1, "u", n), (2, None, 0), (3, "v", 0)]
    assert h.extract(frame.limit(0)).count() == 0


def test_names_that_only_look_marked():
    words = " ".join("many words of the article stand here and go on" for _ in range(4))
    kept = f'<article><div class="entry-header"><h1>Title</h1></div><p class="notice-period">Notice of a month. {words}</p><div class="social-history">Social past. {words}</div></article>'
    assert h.main_text(kept).startswith("Title\n\nNotice of a month.") and "Social past." in h.main_text(kept)
    framed = f'<article><p>{words}</p><div class="cookie-notice">We use cookies</div><div class="site-footer">The end</div><div class="user-comments"><p>First!</p></div></article>'
    assert h.main_text(framed) == words
    own = f'<body><div class="content"><header><h1>Title</h1></header><p>{words}</p><p>{words} <a href="#">last link</a></p></div></body>'
    assert h.main_text(own).startswith("Title") and h.main_text(own).endswith("last link")


GOING = "related-posts share-buttons social-icons newsletter-form advert-label advertorial cookie-law-info author-comments comment-form post-comments sponsored-post promo-card recommended-articles subscribe-cta article-footer nav-previous breadcrumb-trail ad sidebar cookie-notice comments share newsletterSignup".split()
WORDS = " ".join("many words of the article stand here and go on" for _ in range(4))


def test_named_parts_of_an_article_go():
    contents = ["Read it", "<p>Someone said this and that about it in a few words.</p>", f"<p>{WORDS}</p>", '<ul><li><a href="#">One more</a></li><li><a href="#">And another</a></li></ul>', "<label>Mail</label><input name=m><button>Go</button>"]
    for name in GOING:
        for content in contents:
            for page in (f'<article><p>{WORDS}</p><div class="{name}">{content}</div><p>Last.</p></article>', f'<body><div class="content"><p>{WORDS}</p><div class="{name}">{content}</div><p>Last words of it.</p></div></body>'):
                got = h.main_text(page)
                assert got.startswith(WORDS) and "Last" in got and got.count("\n\n") == 1, (name, content, got)


def test_parts_that_only_share_a_name_stay():
    twins = [
        f'<div class="social"><p>Social life was rich in those days. {WORDS}</p></div>', '<p id="search">The search went on.</p>', '<div id="discussion"><h2>Discussion</h2><p>It is not clear why.</p></div>',
        '<div id="menu"><h2>The menu</h2><p>Soup came first.</p></div>', f'<div class="comment-period"><p>The period was long. {WORDS}</p></div>', '<div class="no-sidebar"><p>Wide.</p></div>', f'<div class="discussion-section"><p>{WORDS}</p></div>', f'<section id="related"><h2>Related work</h2><p>{WORDS}</p></section>',
        '<div class="entry-header"><h2>A part</h2></div>', '<p>First <span class="no-ad">and</span> second.</p>',
    ]
    for twin in twins:
        bare = h.main_text(f"<article><p>{WORDS}</p>{h.re.sub(' (class|id)=.[^>]*', '', twin)}<p>Last.</p></article>")
        assert h.main_text(f"<article><p>{WORDS}</p>{twin}<p>Last.</p></article>") == bare, twin
    wrapped = f'<body class="ad"><div class="page sidebar right"><form id="form"><article><p>{WORDS}</p></article></form></div></body>'
    assert h.main_text(wrapped) == WORDS
    # A marked paragraph ends where the next block begins, though its end tag is missing.
    assert h.main_text(f'<article><p class="ad">Buy<p>{WORDS}<div>Last.</div></article>') == f"{WORDS}\n\nLast."


def test_time_in_proportion_to_the_page():
    for part in ("<header>", '<p class="ad">', '<span class="ad">', "<li hidden>", "<nav><article>", '<div class="ad">', "<h2 class='ad'>x", "<ul><li class=ad>", "<form><main>", "<header><h1>a"):
        began = time.time()
        h.main_text(part * 20_000)
        short = time.time() - began
        began = time.time()
        h.main_text(part * 80_000)
        assert time.time() - began < 8 * max(short, 0.1), (part, short, time.time() - began)


def test_the_scan_decides_where_no_element_marks_the_article(monkeypatch):
    pages = [p for p, *_ in h.labelled_pages()]
    with_scan = [h.main_text(p) for p in pages]
    monkeypatch.setattr(h, "best_region", lambda scores: (0, len(scores)))
    changed = sum(h.main_text(p) != t for p, t in zip(pages, with_scan, strict=True))
    assert changed >= 5
