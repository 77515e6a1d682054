import html
import re

import pytest

from passagemill.llm.html_text import extract, main_text
from passagemill.llm.queries import table

SF = "/root/testdata/sf0.001"


def test_articles_come_out_whole(spark):
    for r in extract(table(spark, SF, "pages")).join(table(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        article = r.html[r.html.index("<article>") : r.html.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


NOISE = '<nav><a href="/">Home</a></nav><div id="cookie-notice"><p>We use cookies, many, really, on this page.</p></div><aside><p>Side, bar, text, with, commas.</p></aside><form><p>Sign, up, here.</p></form><footer><p>Footer, text.</p></footer><div class="comments"><p>First comment, nice.</p></div><script>var p = "<p>no</p>";</script><style>p{}</style><div class="advert"><p>Buy, now.</p></div>'


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title></head><body>{NOISE}<article><h1>Head</h1><p>One, two &amp; three.<p>Four<br>five.</article>{NOISE}</body></html>",
        f"<body>{NOISE}<div id=content><h1>Head</h1><p>One, two &amp; three.</p>{NOISE}<p>Four\n five.</p></div>{NOISE}</body>",
        f"<body><main><div><h1>Head</h1><p>One, <b>two</b> &amp; <i>three</i>.</p><p>Four&nbsp;five.</p></div></main>{NOISE}",
    ],
)
def test_noise_goes(page):
    assert main_text(page) == "Head\n\nOne, two & three.\n\nFour five."


def test_short_paragraphs_and_suspect_names_of_an_article_stay():
    long = "<div>" + "<p>Many words, with commas, in a long paragraph of the article.</p>" * 4 + "</div>"
    assert main_text(f"<div><p>Short intro.</p>{long}<p>Short end.</p></div>").startswith("Short intro.\n\nMany") and main_text(f"<div><p>Short intro.</p>{long}<p>Short end.</p></div>").endswith("\n\nShort end.")
    for name in ("widget-text", "related", "share", "alert"):
        page = f'<article><h1>Head</h1><p>One, two.</p><div class="{name}"><p>Body, here</p></div><div class="{name}"><a href="/">More, of this</a></div></article><div class="{name}"><p>Out, there.</p></div>'
        assert main_text(page) == "Head\n\nOne, two.\n\nBody, here"
    assert main_text(f'<body><p><a href="/">Skip to, the text.</a></p>{long}<p>Copyright</p><p>The end.</p></body>').endswith("article.\n\nThe end.")


def test_odd_pages(spark):
    cases = {None: "", "": "", "<": "<", "a < b": "a < b", "<p>x": "x", "<p>a<!-- <p>b -->c": "ac", "<p>&lt;b&gt; &#65;&#x42;": "<b> AB", "<div " * 50: "", "<script>never closed <p>x": "", "plain": "plain"}
    for page, want in cases.items():
        assert main_text(page) == want
    assert len(main_text("<p>" + "long text, " * 100_000)) == len("long text, " * 100_000) - 1
    assert main_text("<div>" * 20_000 + "deep") == "deep"
    df = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (2, "u", "<p>x</p>", "t")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in extract(df).collect() if r.url) == [(2, "u", "x", 1)]
    assert extract(df).count() == 3 and extract(df.where("false")).count() == 0
