import time
from html.parser import HTMLParser

from verdantia.llm import html_extract as H


class Article(HTMLParser):
    """Text of <article>, block by block; for pages whose only main container it is."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.parts = 0, [[]]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.on = 1
        if tag in ("p", "h1", "br"):
            self.parts.append([])

    def handle_endtag(self, tag):
        if tag == "article":
            self.on = 0
        if tag in ("p", "h1"):
            self.parts.append([])

    def handle_data(self, data):
        if self.on:
            self.parts[-1].append(data)


def test_table_against_parser(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = H.op8_html_extract(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        p = Article()
        p.feed(pages[r.page_id] or "")
        p.close()
        want = " ".join(x for x in (" ".join("".join(b).split()) for b in p.parts) if x)
        assert r.text == want and r.n_chars == len(want)


CHROME = """<html><head><title>T</title><style>p{}</style></head><body><header class="site">Head words here</header><nav><a href=x>Home</a></nav>
<div id="cookie-notice">We use cookies on this page, lots of them, really a great many of them indeed</div>
<div class="layout"><div class="post-{n} content"><h1>Title {n}</h1><p>First &amp; foremost   text&nbsp;x, <b>bo</b>ld.<p>Second para &#39;q&#39; &eacute;.<ul><li>one<li>two</ul>
<form><input>Send us words</form><div class="ad">Buy now</div><script>var a = "<p>no</p>";</script><!-- <p>hidden</p> --></div>
<aside>More stories for you to read</aside><div class="comments"><p>Great article, thanks a lot for it, I liked reading every word of it and more</p></div></div>
<footer>&copy; us</footer></body></html>"""


def test_consensus_and_chrome(spark):
    rows = [(i, "http://h.example/a", CHROME.replace("{n}", str(i))) for i in range(5)]
    rows += [(10, "http://H.example:80/b", '<body><div class="layout"><div class="post-7 content"><p>Short.</p></div><div class="teaser"><p>' + "Longer words in a teaser. " * 20 + "</p></div></div>")]
    rows += [(11, None, None), (12, None, ""), (13, "x", "just &lt;text&gt;  here"), (14, "http://h.example/", "<article>Open <b>and never closed"), (15, "q", "<!-- open"), (16, "q", '<p title="a>b">gt</p>')]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    for i in range(5):
        assert got[i] == f"Title {i} First & foremost text x, bold. Second para 'q' é. one two"
    assert got[10] == "Short."  # the host's path wins over the longer container of this page
    assert got[11] == got[12] == got[15] == "" and got[13] == "just <text> here" and got[14] == "Open and never closed" and got[16] == "gt"


def test_empty_table(spark):
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


STORY = "Words that make up prose, number {i} of many, with enough of them to be read as a text and not as a label. "


def layout(n, doubt, lines=4, links=False):
    """A page whose article holds a container with a doubtful class."""
    inner = "".join(f"<p>{STORY.format(i=f'{n}.{i}')}</p>" for i in range(lines))
    if links:
        inner = "".join(f"<a href=x>{STORY.format(i=f'{n}.{i}')}</a> " for i in range(lines))
    return f'<body><div class="top-nav">Home</div><article><h1>Title {n}</h1><p>{STORY.format(i=n) * 3}</p><div class="{doubt}">{inner}</div></article></body>', inner


def test_doubtful_words_are_settled_by_the_host(spark):
    rows, want = [], {}
    head = lambda n: f"Title {n} " + " ".join((STORY.format(i=n) * 3).split())
    for n in range(6):
        for host, doubt, kept, links in (("a", "login-story social", True, False), ("b", "search-results", True, False), ("c", "related", False, True), ("d", "comments", False, False), ("e", "cookie-notice", False, False)):
            page, _ = layout(n, doubt, links=links)
            rows.append((f"{host}{n}", f"http://{host}.example/{n}", page))
            want[f"{host}{n}"] = head(n) + (" " + " ".join(" ".join(STORY.format(i=f"{n}.{i}").split()) for i in range(4)) if kept else "")
        page, _ = layout("same", "widget", lines=8)  # the same text on every page of the host
        rows.append((f"f{n}", f"http://f.example/{n}", page))
        want[f"f{n}"] = head("same")
    df = spark.createDataFrame(rows, "page_id string, url string, html string").repartition(5)
    assert {r.page_id: r.text for r in H.extract(df).collect()} == want


def test_long_and_deep_pages_take_linear_time():
    n = 100_000
    hard = ["<a " * 350_000, '<a "> ' * n, "<div>" * n, "<div>" * n + "</ul>" * n, "<b><div>" + "<i>" * n + "</b>" * n, "<div " + "a" * 10 * n + ">x", "<!-- " * n, "</" * n, "<p a='" * n, "<header>" * n]
    for page in hard:
        start = time.time()
        H.Page(page).doubts()
        assert time.time() - start < 20, page[:20]
    deep = H.Page("<div>" * n + "deep" + "</div>" * n + "<p>end")
    assert len(deep.nodes) == n + 1 and [t for _, t, _ in deep.blocks] == ["deep", "end"]
    long = "word " * 400_000
    assert H.Page(f"<article><p>{long}</p></article>").blocks[0][1] == long.strip()


def test_malformed_tags():
    read = lambda h: [t for _, t, _ in H.Page(h).blocks]
    assert read("a < b and 3 <4 <p>x") == ["a < b and 3 <4", "x"]
    assert read('<p title="it\'s 5" tall">one</p><p>two</p>') == ["one", "two"]
    assert read("<table><tr><td>1<td><b>2<td>3<tr><td>4</table>5") == ["1", "2", "3", "4", "5"]
    assert read("<p>x<button>no</button>y<select><option>no</select>z") == ["x", "y", "z"]
    assert read('<svg/><p hidden>no</p><p style="display : none">no</p><p aria-hidden=true>no</p>yes') == ["yes"]


def social(n, article, passage):
    return (n, f"https://h.org/{n}", f"<html><body><nav>menu</nav><article><h1>Title {n}</h1><p>{article}</p><div class='social'>{passage}</div></article></body></html>")


def texts(spark, rows):
    return {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_short_prose_in_a_doubtful_part_of_the_article_stays(spark):
    """However short it is: 102, 199 and 200 characters alike."""
    for size in (20, 102, 199, 200):
        rows = [social(n, f"Words of article number {n}. " * 20, f"{n} " + "x" * (size - 2)) for n in range(1, 4)]
        found = texts(spark, rows)
        assert all(found[n].endswith(f"{n} " + "x" * (size - 2)) for n in range(1, 4))


def test_repeated_rows_extract_as_one(spark):
    passage = "A passage of the article itself. " * 9
    page = social(1, "Words of the article. " * 20, passage)
    alone = texts(spark, [page])[1]
    assert alone.endswith(passage.strip())
    assert texts(spark, [page] * 3) == {1: alone}
    assert set(texts(spark, [(n, *page[1:]) for n in range(5)]).values()) == {alone}


def test_what_stands_alike_on_different_pages_goes(spark):
    rows = [social(n, f"Words of article number {n}. " * 20, "Share this with your friends") for n in range(1, 6)]
    assert all("Share this" not in t and f"number {n}" in t for n, t in texts(spark, rows).items())
