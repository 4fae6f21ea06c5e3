"""Pages with omitted tags, and articles whose text stands in several containers."""

import pytest

from topicloom.llm.html_consensus import main_text
from topicloom.llm.warc_derivatives import derivatives, responses_of_pages

OPEN_HEADS = [
    "<html><head><title>T</title><meta charset=utf-8><body><p>First text, here.<p>Second text.",
    "<head><title>T</title><p>First text, here.<p>Second text.",
    "<head><title>T</title>\n<noscript><img src=x></noscript>First text, here.<p>Second text.",
]


def texts(spark, pages):
    rows = [(i, f"https://h{i}.example/", p) for i, p in enumerate(pages)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_pages_without_end_of_head(spark):
    pages = texts(spark, OPEN_HEADS)
    got = [r.text for r in main_text(pages).orderBy("page_id").collect()]
    assert got == ["First text, here.\nSecond text."] * 3
    records = derivatives(responses_of_pages(pages, "2024-01-01T00:00:00Z")).filter("type = 'conversion'").collect()
    assert len(records) == 3 and all("First text, here." in r.block for r in records)


BODY = "Running text, with commas, of some length, as an article has. " * 3
ARTICLES = [
    f"<article><h1>Title</h1><p>Lead, short.</p><section><p>{BODY}</p></section><section><p>{BODY}</p></section></article>",
    f"<article><h1>Title</h1><div class=lead><p>Lead, short.</p></div><div class=text><p>{BODY}</p><p>{BODY}</p></div></article>",
    f"<main><h1>Title</h1><p>Lead, short.</p><div class=wrap><div class=text><p>{BODY}</p><p>{BODY}</p></div></div></main>",
    f"<table><tr><td><h1>Title</h1><p>Lead, short.</p><div><p>{BODY}</p><p>{BODY}</p></div></td></tr></table>",
    f"<div class=page><h1>Title</h1><p>Lead, short.</p><table><tr><td>{BODY}</td><td>{BODY}</td></tr></table></div>",
]


@pytest.mark.parametrize("links", ["", "<div class=more><a href=/a>Another page of this site</a> <a href=/b>One more page of it</a></div>"])
def test_articles_in_several_containers(spark, links):
    pages = texts(spark, [f"<html><head><title>T</title></head><body>{a}{links}</body></html>" for a in ARTICLES])
    whole = "\n".join(["Title", "Lead, short.", BODY.strip(), BODY.strip()])
    assert [r.text for r in main_text(pages).orderBy("page_id").collect()] == [whole] * len(ARTICLES)


WHOLE = [
    '<div class="content with-sidebar">{}</div>',
    '<div id="main" class="no-sidebar">{}</div>',
    '<div class="post comments-open">{}</div>',
    '<form id="aspnetForm"><div class="page">{}</div></form>',
    "<article><header><h1>Title</h1></header>{}</article>",
    '<article><div class="article-header"><h1>Title</h1></div>{}</article>',
]


def test_layout_words_are_no_furniture(spark):
    text = f"<p>{BODY}</p><p>{BODY}</p>"
    furniture = "<div class='comment-list'><p>First! Nice one, thanks.</p></div><div class='ad-banner'>Buy now.</div><form><p>Subscribe here.</p></form>"
    pages = texts(spark, [f"<html><body>{furniture}{w.format(text)}</body></html>" for w in WHOLE])
    got = [r.text for r in main_text(pages).orderBy("page_id").collect()]
    body = "\n".join([BODY.strip()] * 2)
    # The subscription form stands beside the page's own form and is as good as it.
    assert got[:3] == [body] * 3 and got[3].endswith(body) and got[4:] == [f"Title\n{body}"] * 2


def test_deep_unclosed_and_long_pages(spark):
    deep = "<div>" * 50_000 + f"<p>{BODY}</p>"
    stray = "<div>" * 20_000 + "</b>" * 50_000 + f"<p>{BODY}</p>"
    hidden = f"<article><p>{BODY}</p></article><!-- <p>{BODY}</p>"
    long = f"<article><p>{BODY * 20_000}</p></article>"
    pages = texts(spark, [deep, stray, hidden, long, "", None])
    got = [r.text for r in main_text(pages).orderBy("page_id").collect()]
    assert got == [BODY.strip()] * 3 + [(BODY * 20_000).strip(), "", ""]


def test_pages_made_of_known_blocks(spark):
    """Articles of random shape between menus, adverts, notices and comments come out word for word."""
    import random

    rng = random.Random(10)
    words = "river stone garden window music paper winter bridge market letter".split()

    def sentence():
        return " ".join(rng.choice(words) for _ in range(rng.randrange(9, 18))).capitalize() + ", and so on."

    menu = "<nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav>"
    rest = ["<div class=ads>Buy this.</div>", "<aside>See also this.</aside>", "<div class=cookie-notice>We use cookies.</div>", "<form><input>Search</form>", "<script>var x = 1;</script>"]
    comments = "<section class=comments><p>Great, thanks!</p><p>I agree.</p></section>"
    pages, want = [], []
    for _ in range(40):
        blocks = [" ".join(sentence() for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(3, 9))]
        body = "".join(f"<p>{b}</p>" + (rng.choice(rest) if rng.random() < 0.2 else "") for b in blocks)
        pages.append(f"<html><head><title>x</title></head><body>{menu}<header>Site</header><article>{body}</article>{comments}<footer>Legal</footer></body></html>")
        want.append("\n".join(blocks))
    frame = spark.createDataFrame([(i, "https://one.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    assert [r.text for r in main_text(frame).orderBy("page_id").collect()] == want
