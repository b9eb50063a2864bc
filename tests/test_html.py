"""The page reader against the standard library's parser, in linear time; JSON-LD; sites."""

import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from webgrain.operators import html


class Plain(HTMLParser):
    """Texts, titles, anchors, images in headers, by the standard library."""

    def __init__(self, markup):
        super().__init__(convert_charrefs=True)
        self.text, self.title, self.anchors, self.images, self.open = [], [], [], [], []
        self.feed(markup)
        self.close()

    def handle_starttag(self, tag, attrs):
        given = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        if tag == "a" and "href" in given:
            self.anchors.append(given["href"].strip())
        if tag == "img" and given.get("src"):
            self.images.append((given["src"], any(t in ("header", "nav") for t in self.open)))
        if tag not in html.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if self.open and self.open[-1] == "title" and "title" in self.open:
            self.title.append(data)
        if "body" in self.open and not any(t in html.HIDDEN for t in self.open):
            self.text.append(data)


def squeezed(parts):
    return re.sub(r"\s+", " ", "".join(parts)).strip()


PIECES = ["<p>", "</p>", "<div class='x'>", "</div>", "<header>", "</header>", "<nav id=n>", "</nav>", "text ", "a &amp; b", "&lt;tag&gt;", "&copy;", "é😀", "<br>", "<br/>", "<img src=a.png alt='A \"q\"'>", '<img src="b&amp;c.jpg">', "<a href='/x y'>l</a>", "<a href=z>", "</a>", "<!-- c <p> -->", "<script>var a = '<p>';</script>", "<style>p{}</style>", "<svg><g>no</g></svg>", "\n\t", "1 > 0", "</span>", "<noscript>n</noscript>", "<b", "><i>", "</i>"]


def test_pages_equal_the_standard_parser():
    draw = random.Random(11)
    for _ in range(1500):
        markup = "<html><head><title>T &amp; t</title></head><body>" + "".join(draw.choices(PIECES[:-3], k=draw.randrange(30))) + "</body></html>"
        plain, read = Plain(markup), html.read_page(markup)
        assert read["text"] == squeezed(plain.text), markup
        assert read["title"] == squeezed(plain.title) == "T & t"
        assert read["anchors"] == plain.anchors
        assert [(x["src"], x["in_header"]) for x in read["images"]] == plain.images


@pytest.mark.parametrize("markup", ["<", "<a ", "<a b='", "<!--", "<script>", "</", "<p>", "<div><p>", "a&", "<a b=c ", '<"', "<title>", "<footer>x", "&#", "<svg>", "</div>", "<!"])
def test_any_markup_in_linear_time(markup):
    began = time.time()
    html.read_page(markup * 20_000)
    assert time.time() - began < 6


def test_linked_data():
    data = {"@context": "x", "@graph": [{"@type": ["Thing", "LocalBusiness"], "email": "a@b.co", "logo": "https://x.org/l.png", "contactPoint": {"telephone": "1", "email": 7}}, {"image": {"url": "i.png"}, "address": {"streetAddress": "s", "postalCode": 5}}, {"image": ["https://no.org/x"], "name": "none"}], "address": "12 Long Street"}
    images, emails, phones, addresses = html.linked_data(data)
    assert images == ["https://x.org/l.png", "i.png"] and emails == ["a@b.co"] and phones == ["1", "1"]  # a contact point speaks for its owner and for itself
    assert addresses == ["12 Long Street", ["s", "", "", "", ""]]


def test_summary_of_odd_pages(spark):
    rows = [(1, "https://x.org/contact", None), (2, "https://x.org/", ""), (3, None, "<title>t</title><body>b"), (4, "https://x.org/", "no tags at all"), (5, "https://x.org/a/", '<body><img src="logo.png" alt="' + "a" * 200 + '"><div role=contentinfo>' + "f" * 3000 + "</div>")]
    out = {r["page_id"]: r for r in html.page_summaries(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert out[1]["page_type"] == "contact" and [x["url"] for x in out[1]["logos"]] == ["https://x.org/favicon.ico"]
    assert out[3]["title"] == "t" and out[3]["logos"] == [] and out[3]["visible_text"] == "b"
    assert out[4]["visible_text"] == "no tags at all" and out[2]["visible_text"] == ""
    assert out[5]["logos"][1]["url"] == "https://x.org/a/logo.png" and len(out[5]["logos"][1]["alt"]) == 120 and len(out[5]["footer"]) == 2000


def test_sites(spark):
    text = "word " * 60
    rows = [
        (1, "https://www.x.org/", f"<title>Home</title><body>{text}<a href='mailto:a@x.org'>m</a>"),
        (2, "https://x.org/about", f"<body>{text}<a href='mailto:gone@x.org'>m</a>"),
        (3, "https://x.org/contact", "<body>other text<a href='mailto:A@X.org'></a><a href='mailto:b@x.org'></a><footer>a footer that is long enough</footer>"),
        (4, "https://x.org/zzz", "<body>late"), (5, "https://x.org/shop", "<body>shop"), (6, "https://y.org/only", "<body>y"), (7, "nothing", "<body>"),
    ]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    out = {r["site"]: r for r in html.assemble_sites(df).collect()}
    assert set(out) == {"x.org", "y.org"}
    x = out["x.org"]
    assert (x["home_id"], x["title"], x["n_pages"], x["n_kept"], x["emails"], x["page_types"], x["diagnostics"]) == (1, "Home", 4, 3, ["a@x.org", "b@x.org"], ["contact", "services"], [])
    assert x["footer"] == "a footer that is long enough" and out["y.org"]["diagnostics"] == ["scrape_depth_low"]
    assert [(r["id"], r["place"]) for r in html.site_pages(df).filter("site = 'x.org'").orderBy("place").collect()] == [(1, 0), (2, 1), (5, 2), (3, 3)]
    assert html.assemble_sites(df.limit(0)).count() == 0


def test_extra_columns_stay_and_clashing_ones_are_replaced(spark):
    df = spark.createDataFrame([("https://x.org", "<title>t</title>", "old", 5)], "url string, html string, title string, n int")
    out = html.page_summaries(df)
    assert out.columns[:2] == ["url", "n"] and out.columns.count("title") == 1 and out.select(F.col("title")).first()[0] == "t"
