import itertools
import random
from html.parser import HTMLParser

from faultlens.llm import html_extract as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site"><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site. Accept them all.</div><!-- ad 3 -->
<div class="ad">Buy the best shoes of the town today, really.</div>
<article><h1>A   title</h1><p><b>First&nbsp;paragraph &amp; more
 of it, long enough to be an article.<br><p>Second one &lt;here&gt;, as long as the first of them is.</p><p>Short.</p></article>
<aside><p>Related things that nobody reads, in a sidebar of the page.</p></aside>
<form><label>Name</label><input name=x><button>Send it</button></form>
<section id="comments"><p>I think that this is a great article, thank you for it.</p></section>
<footer>&copy; us &middot; all rights reserved by the makers of this page.</footer></body></html>"""


def test_main_text():
    assert h.main_text(PAGE) == "A title\nFirst paragraph & more of it, long enough to be an article.\nSecond one <here>, as long as the first of them is.\nShort."


def test_cut_off_and_broken():
    assert h.main_text(None) == h.main_text("") == h.main_text("<html><body></body>") == ""
    at = PAGE.index("of them is")
    assert h.main_text(PAGE[:at]).endswith("as long as the first")
    assert h.main_text(PAGE[: at] + "<p").endswith("first")
    assert "var" not in h.main_text(PAGE[: PAGE.index("</script>")])
    h.main_text("<" * 2000 + "</p>" * 2000 + "<div " * 50 + "&#xZZ; &#99999999;")


def test_div_soup():
    page = "<div class=menu><a href=x>One</a> <a href=y>Two</a></div>" + "".join(f"<div><p>Sentence number {i} of a page that has no article element, but enough words.</p></div>" for i in range(4)) + "<div class='footer'>imprint</div>"
    text = h.main_text(page)
    assert text.count("\n") == 3 and "One" not in text and "imprint" not in text


SAYS = [" ".join(f"word{i}" for i in range(40)) + f" of paragraph {k}." for k in range(3)]
NAV, FOOT = "<nav><a href=x>Home</a></nav>", "<footer>Imprint of the makers of this page.</footer>"


def test_layout_words_of_wrappers():
    text = "".join(f"<p>{x}</p>" for x in SAYS)
    for name in ("has-sidebar", "sidebar-right", "nav-fixed", "comments-open", "notice", "social", "share", "banner", "page-with-banner widget"):
        assert h.main_text(f'<html><body class="{name}">{NAV}<div>{text}</div>{FOOT}</body></html>') == "\n".join(SAYS), name
        assert h.main_text(f'<html class="{name}"><body>{NAV}<div id="page" class="{name}"><div class="{name}">{text}</div></div>{FOOT}</body></html>') == "\n".join(SAYS), name
    aside = "<p>Long plain text at the side that is part of no article, with a number of words that ends here.</p>"
    assert "\n".join(SAYS) in h.main_text(f'<body>{aside}<div class="sidebar-page"><h1>Title</h1>{text}</div></body>')
    assert "\n".join(SAYS) in h.main_text(f'<body>{aside}<div class="no-sidebar">{text}</div></body>')


def test_long_parts_that_are_no_wrappers():
    for name in ("comments", "sidebar", "related", "page-sidebar"):
        part = f'<div class="{name}">' + "".join(f"<p>{x}</p>" for x in SAYS[1:]) + "</div>"
        assert h.main_text(f"<body>{NAV}<div><p>{SAYS[0]}</p></div>{part}{FOOT}</body>") == SAYS[0], name
        assert h.main_text(f'<body><div class="social-layout">{NAV}<div><p>{SAYS[0]}</p></div>{part}</div>{FOOT}</body>') == SAYS[0], name


OUTSIDE = {
    "aside": "<aside><p>{}</p></aside>",
    "form": "<form><p>{}</p><label>Name</label></form>",
    "nav": "<nav><p>{}</p></nav>",
    "footer": "<footer><p>{}</p></footer>",
    "header": "<header><p>{}</p></header>",
    "comments": '<div class=comments><div class="comment-body post-content"><p>{}</p></div></div>',
    "newsletter": '<div class="newsletter"><p>{}</p></div>',
    "notice": '<section role="alert"><p>{}</p></section>',
    "hidden": '<div style="display: none"><p>{}</p></div>',
    "list": '<ul class="share-links"><li>{}</li></ul>',
    "inline": '<p>A sentence<span class="share"> {}</span> that goes on.</p>',
}


def test_nothing_from_outside_within_articles():
    say = " ".join(f"other{i}" for i in range(45)) + "."
    for name, part in OUTSIDE.items():
        for around in ("<main><article class='post-content entry'>{}</article></main>", "<article>{}</article>", "<div class='content'>{}</div>", "{}"):
            text = h.main_text("<body>" + around.format(f"<p>{SAYS[0]}</p>{part.format(say)}<p>{SAYS[1]}</p>") + "</body>")
            assert text == (f"{SAYS[0]}\nA sentence that goes on.\n{SAYS[1]}" if name == "inline" else f"{SAYS[0]}\n{SAYS[1]}"), (name, around)


def test_headings_of_an_articles_header():
    page = f"<body><header><h1>Site</h1><p>{SAYS[2]}</p></header><article><header><h1>Title</h1><p>By somebody on some day.</p></header><p>{SAYS[0]}</p></article></body>"
    assert h.main_text(page) == f"Title\n{SAYS[0]}"


def test_short_pages():
    assert h.main_text("<p>Hello</p>") == "Hello" and h.main_text("Hello world") == "Hello world"
    assert h.main_text(f"<body>{NAV}<div><p>Hello there</p></div>{FOOT}</body>") == "Hello there"
    assert h.main_text(f"<body>{NAV}<form><label>Name</label></form>{FOOT}</body>") == ""
    assert h.main_text(f"<nav><p>{SAYS[0]}</p></nav>") == h.main_text(f"<aside><p>{SAYS[0]}</p></aside>") == ""


def test_wrapping_forms_and_topics():
    text = "".join(f"<p>{x}</p>" for x in SAYS)
    assert h.main_text(f"<body><form id=f>{NAV}<h1>Title</h1>{text}{FOOT}</form></body>") == "\n".join(["Title", *SAYS])
    assert h.main_text(f'<body class="single category-legal"><article class="post tag-social sponsored"><h1>Title</h1>{text}</article></body>') == "\n".join(["Title", *SAYS])


def test_ties_are_boilerplate():
    assert h.min_cut([0.0, 1.0], [0.0, 1.0], []) == [False, False]


def test_min_cut_is_least():
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randint(1, 8)
        keep, drop = ([round(rng.random() * 4, 2) for _ in range(n)] for _ in range(2))
        edges = [(a, b, round(rng.random() * 3, 2)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]

        def cost(x, keep=keep, drop=drop, edges=edges):
            return sum(d if k else c for k, c, d in zip(x, keep, drop)) + sum(w for a, b, w in edges if x[a] != x[b])

        assert abs(cost(h.min_cut(keep, drop, edges)) - min(map(cost, itertools.product([True, False], repeat=n)))) < 1e-6


def test_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (3, "u", "<p>" + "word " * 20000 + ".</p>", "y")]
    out = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.n_chars > 0 for r in got} == {1: True, None: False, 3: True}
    assert h.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


class Reading(HTMLParser):
    """The paragraphs and headings inside <article>, read plainly."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("article", "p", "h1", "h2", "h3", "li", "ul", "div", "td", "tr", "table", "blockquote", "pre"):
            self.parts.append("")
        elif tag == "br":
            self.parts[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag not in ("b", "i", "a", "em", "strong", "span"):
            self.parts.append("")

    def handle_data(self, data):
        if self.inside:
            self.parts[-1] += data

    def text(self):
        return "\n".join(x for x in (" ".join(p.split()) for p in self.parts) if x)


def test_query_against_a_plain_reading(spark):
    from faultlens.llm.queries import op1_html_extraction

    got = {r.page_id: r.text for r in op1_html_extraction(spark, "/root/testdata/sf0.001").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert len(got) == len(pages) > 0
    for page in pages:
        if page.html and "<article" in page.html:
            reading = Reading()
            reading.feed(page.html)
            reading.close()
            assert got[page.page_id] == reading.text(), page.page_id


def test_deep_nesting_takes_linear_time():
    import time

    page = lambda n: "<body>" + "<div class=ad><p>some words here</p>" * n + "</div>" * n + "</body>"
    began = time.perf_counter()
    assert h.main_text(page(200)).startswith("some words here")  # the outermost wraps the page
    h.main_text(page(20_000))
    inline = "<body>" + "<span class=ad>" * 5000 + "<p>a b c</p>" * 5000
    h.main_text(inline)
    assert time.perf_counter() - began < 15


def test_parts_of_an_articles_class_do_not_speak_against_it():
    text, other = "One two three four five six seven eight nine ten.", "<article><p>Other words are here for the reader to see now.</p></article>"
    for name in ("ad-free", "post category-x social-policy", "no-sidebar"):
        assert text in h.main_text(f"<article class='{name}'><p>{text}</p></article>{other}")
    assert text not in h.main_text(f"<article class='ad'><p>{text}</p></article>{other}")
