import random
import time
from collections import Counter

import pytest

from weirflow.llm import html_extract
from weirflow.llm.html_extract import PLAIN, extract, extract_main_text, label_counts, learn_weights, region, weights_from

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/a">Home</a></li><li><a>About</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><!-- <p>hidden</p> -->
<article><h1>The &amp; title</h1><p>First <b>bold</b>&nbsp; text
goes on &lt;here&gt; with many words in it.<p>Second paragraph &eacute; of the text with words.<br>line two</p>
<div class="ad">Buy this now</div><form><input><label>Mail</label></form><ul><li>Item one</li><li>Item two</li></ul><p>End.</p>
<section id="comments"><p>First! What a long and wordy comment by a reader of this page.</p></section></article>
<aside>Related posts</aside><footer>&copy; us</footer></body></html>"""
TEXT = "The & title\nFirst bold text goes on <here> with many words in it.\nSecond paragraph é of the text with words. line two\nItem one\nItem two\nEnd."


def test_article_without_boilerplate():
    assert extract(PAGE) == TEXT


def test_page_without_article_element():
    assert extract(PAGE.replace("article>", "div>")) == TEXT
    assert extract(PAGE.replace("<article>", '<div class="post-content">').replace("</article>", "</div>")) == TEXT


@pytest.mark.parametrize("source", [None, "", "   ", "<html></html>", "<nav>only a menu</nav>", "<script>x", "<!-- open", "<", "<a <b", "</p></div>"])
def test_pages_without_text(source):
    assert extract(source) in ("", "<")


def test_broken_markup_and_long_pages():
    assert extract("<p>plain text") == "plain text"
    assert extract("<article><p>a &am b &#x41; <i>c") == "a &am b A c"
    long = "<article>" + "<p>some words in here</p>" * 20_000 + "</article>"
    assert extract(long).count("\n") == 19_999
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    assert extract(deep) == "deep text"
    assert extract('<a "' * 2000 + "text") is not None


def test_frame(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "y"), (2, None, None, "z"), (None, "v", "<p>t w o</p>", "q"), (3, "w", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extract_main_text(df).collect()), key=str)
    assert got == sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "v", "t w o", 5), (3, "w", "", 0)], key=str)
    none = df.limit(0)
    assert learn_weights(none) == PLAIN and extract_main_text(none).count() == 0


WORDS = "Many words of the text that the page is about stand here."


@pytest.mark.parametrize("kept", ['<section id="related-work"><p>{}</p></section>', '<h2 id="search-algorithms">{}</h2>', '<h2 id="search">{}</h2>', '<div class="share-prices">{}</div>', '<p class="social-history">{}</p>', '<div class="no-comments with-menu">{}</div>', '<section id="adAgency">{}</section>', '<div class="notice_period">{}</div>'])
def test_names_that_only_hold_a_boilerplate_word(kept):
    part = kept.format("Kept part of the article.")
    assert extract(f"<article><p>{WORDS}</p>{part}<p>{WORDS}</p></article>") == f"{WORDS}\nKept part of the article.\n{WORDS}"


@pytest.mark.parametrize("dropped", ['<div class="related-posts">{}</div>', '<div id="shareButtons">{}</div>', '<div class="box cookie_notice">{}</div>', '<p class="ad">{}</p>', '<section id="comments">{}</section>', '<ul class="main-nav">{}</ul>'])
def test_names_that_say_boilerplate(dropped):
    assert extract(f"<article><p>{WORDS}</p>{dropped.format('Left out.')}<p>{WORDS}</p></article>") == f"{WORDS}\n{WORDS}"


@pytest.mark.parametrize("wrapper", ['class="site has-sidebar"', 'class="with-nav"', 'id="no-footer"', 'class="has-header page"'])
def test_wrapper_named_for_what_the_page_has(wrapper):
    assert extract(f"<body><div {wrapper}><div><p>{WORDS}</p><p>{WORDS}</p></div><div class=sidebar>Menu</div></div></body>") == f"{WORDS}\n{WORDS}"


MARKED = """<html><body><nav><ul><li><a href="/">Home page</a></li><li><a href="/b">Other page</a></li></ul></nav>
<div class="ad">Buy more things now.</div><article><h1>A title of words</h1><p>{}</p><p>{}</p></article><footer>Some owner of the page and its words.</footer></body></html>"""
UNMARKED = """<html><body><div><ul><li><a href="/">Home page</a></li><li><a href="/b">Other page</a></li></ul></div>
<div>Buy more things now.</div><div><h1>A title of words</h1><p>{0}</p><p>{0}</p></div><div>Some owner of the page and its words.</div></body></html>"""


def learned():
    counts = Counter()
    for n in range(20):
        counts.update(label_counts(MARKED.format(WORDS, " ".join([WORDS] * (n % 3 + 1)))))
    return weights_from(counts)


def test_the_scan_finds_what_nothing_marks(monkeypatch):
    """Without a single mark the region alone parts the article from the rest; without the scan, all words stay."""
    text = f"A title of words\n{WORDS}\n{WORDS}"
    assert extract(UNMARKED.format(WORDS), learned()) == text
    monkeypatch.setattr(html_extract, "region", lambda score: (0, len(score) - 1))
    assert extract(UNMARKED.format(WORDS), learned()) != text


def test_the_scan_decides_among_elements_that_say_article():
    """A teaser in an article element of its own does not win over the text."""
    page = UNMARKED.format(" ".join([WORDS] * 5)).replace("<div>Buy more things now.</div>", "<article>Buy now.</article>")
    assert "Buy now" not in extract(page, learned()) and WORDS in extract(page, learned())


def test_article_of_what_no_labelled_page_has():
    items = "".join(f"<li><a href=x>Item {i}</a> of the list</li>" for i in range(30))
    got = extract(f"<body><nav><a>Home</a></nav><article><h1>Title</h1><p>{WORDS}</p><ul>{items}</ul><table><tr><td>cell<td>other</table></article><footer>End</footer></body>", learned())
    assert got.split("\n") == ["Title", WORDS, *(f"Item {i} of the list" for i in range(30)), "cell", "other"]


def test_region_against_all_intervals():
    rng = random.Random(8)
    for _ in range(300):
        score = [rng.choice([-6, -1, -0.5, 0, 0.25, 1, 2, 7]) for _ in range(rng.randint(0, 24))]
        sums = {(a, b): sum(score[a : b + 1]) for a in range(len(score)) for b in range(a, len(score))}
        best = max(sums.values(), default=0)
        found = region(score)
        assert found is None if best <= 0 else sums[found] == best


def test_weak_names_are_left_to_the_scores():
    prose = f"<section id='related'><p>{WORDS} {WORDS} {WORDS}</p></section>"
    links = "<section id='related'><ul>" + "<li><a href=x>Other page</a></li>" * 5 + "</ul></section>"
    for weights in (PLAIN, learned()):
        assert extract(f"<article><p>{WORDS}</p>{prose}<p>{WORDS}</p></article>", weights).count(WORDS) == 5
    assert "Other page" not in extract(f"<article><p>{WORDS}</p>{links}<p>{WORDS}</p></article>")


@pytest.mark.parametrize("source", ["<a " * 10**6, "<b>" * 10**5 + "text", "<div>" * 10**5 + "text" + "</div>" * 10**5, "<p>a</b>" * 10**5, "<li><tr><b>" * 10**4 + "<li></li>" * 10**5, '<a ">' * 10**5 + "'", "<a \"'>" * 10**5, "<a '\">" * 10**5 + "\"'", "<!--" * 10**5, "<ul><li><b>" + "<i>" * 10**5 + "<hr><option></option>" * 10**5, "<section class=related>" * 10**5 + "x"])
def test_broken_pages_take_linear_time(source):
    began = time.time()
    extract(source)
    assert time.time() - began < 10
