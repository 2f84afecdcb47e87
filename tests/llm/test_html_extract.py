import html
from html.parser import HTMLParser

from ledgerloom.llm.html_extract import align, digest_of, extract, main_text, merge, op2_html_extraction, parse, rule, wrapper_of

BLOCK = {"p", "h1", "h2", "li", "article", "section", "div", "ul", "blockquote"}


class Plain(HTMLParser):
    """The blocks inside <article>, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.blocks += [""] * (tag in BLOCK)
        self.blocks[-1] += " " * (tag == "br")

    def handle_endtag(self, tag):
        self.blocks += [""] * (tag in BLOCK)
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside > 0:
            self.blocks[-1] += data


def plain(page):
    p = Plain()
    p.feed(page or "")
    p.close()
    return "\n".join(x for x in (" ".join(b.split()) for b in p.blocks) if x)


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    rows = op2_html_extraction(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var a="<p>no</p>";</script></head>
<body class="has-sidebar"><header>Site <h1>Name</h1></header><div id="cookie-notice">We use cookies</div><nav><ul><li><a href=x>Home</a><li>B</ul></nav>
<main><div class="post"><h1>Title &lt;1&gt;</h1><p>First <b>bold</b>&nbsp;text<br>more &copy; a &am b<p class=x title="a > b">Second
line <!-- <p>none</p> --></p><div class='ad-slot'>Buy!</div><ul><li>one<li>two</ul><form><p>mail</p></form><blockquote>Said.</blockquote><pre> x
 y</pre></div></main><aside>Side</aside><section class="comments"><article>Nice!</article></section><footer>&copy; me</footer></body></html>"""
TEXT = "Title <1>\nFirst bold text more © a &am b\nSecond line\none\ntwo\nSaid.\nx y"


def test_a_page_with_everything():
    assert main_text(PAGE, None) == TEXT


def test_pages_without_landmarks(spark):
    page = "<html><body><div class=top><a href=/>Home</a> <a href=/b>About us and more</a></div><div class=wrap><div class=c0><h2>%s</h2><p>%s</p>%s</div><div class=fine>All rights reserved by us</div></div></body></html>"
    rows = [(i, f"http://User@Some.Host:80/{i}", page % (f"Head {i}", f"Words number {i} " * 30, "<p>Also</p>" * (i % 3)), "own") for i in range(6)]
    rows += [(9, None, None, "z"), (9, "x", "", "z"), (10, "http://other/", "just text < 5 &amp; more", "y"), (10, "http://other/", "just text < 5 &amp; more", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in extract(df).collect()}
    for i in range(6):
        assert got[i].text == "\n".join([f"Head {i}", ("Words number %d " % i * 30).strip()] + ["Also"] * (i % 3))
    assert got[9].text == "" and got[9].n_chars == 0 and got[10].text == "just text < 5 & more"
    assert extract(df).count() == len(rows) and extract(df.limit(0)).count() == 0


def test_wrapper_has_options_and_repeats():
    w = wrapper_of(parse("<ul><li>a<li>b</ul><p>x</p>"))
    v = wrapper_of(parse("<ul><li>a</ul><h2>y</h2><p>x</p><h2>z</h2>"))
    both = merge(w, v)
    kinds = {c[0]: c for c in both[-1]}
    assert not kinds["ul"][2] and kinds["ul"][-1][0][3] and kinds["h2"][2] and kinds["h2"][3]
    assert both[4] == 2 and kinds["ul"][4] == 2
    assert align([], []) == []


def test_size_does_not_grow_with_pages():
    page = lambda n: "<article>" + "".join(f"<p>{i}</p>" + "<h3>h</h3>" * (i % 2) + "<ul>" + "<li>x" * (i % 4) + "</ul>" for i in range(n)) + "</article>"
    one = wrapper_of(parse(page(3)))
    for n in range(1, 60):
        one = merge(one, wrapper_of(parse(page(n))))
    assert len(str(one)) < 4000  # about four texts for each that a page has in a slot
    assert rule(one)[0] == ["article"]


def test_hard_pages():
    for page in ("<" * 3000, "<p" * 3000, "<a href=\"" * 2000, "<div>" * 300 + "x", "<!-- a", "<script>x", "</p></div>", "&#xZZ; &#99999999; &lt", "<p>" * 3000):
        assert isinstance(main_text(page, [["html", "body"], []]), str)
    long = "<article><p>" + "word &amp; " * 200000 + "</p></article>"
    assert main_text(long, None) == html.unescape("word &amp; " * 200000).strip()


def test_copies_do_not_make_boilerplate(spark):
    """Fixed slots need different contents around them; headings and a page's only text stay."""
    copy = "<body><div><h1>T</h1><p>short text</p></div></body>"
    recipe = "<body><div><h1>Recipe</h1><p>%s</p><div>All rights reserved</div></div></body>"
    rows = [(i, "http://copies/", copy) for i in range(4)] + [(10 + i, "http://recipes/", recipe % (f"Stir {i} times " * 20)) for i in range(4)]
    rows += [(20 + i, "http://two/", recipe % (f"Stir {i % 2} times " * 20)) for i in range(6)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "T\nshort text" for i in range(4))
    assert all(got[10 + i] == "Recipe\n" + (f"Stir {i} times " * 20).strip() for i in range(4))
    assert all(got[20 + i].endswith("All rights reserved") for i in range(6))


def texts(spark, html_of, n=6):
    rows = [(i, "http://host/", html_of(i)) for i in range(n)]
    return {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def body(i):
    return f"Story number {i} has words of its own. " * (8 + i)


def test_lines_that_pages_repeat_inside_articles(spark):
    """Constants of the wrapper go whatever their class or length; slots and headings stay."""
    long = "We value what you read and would like to say so at some length. " * 12
    page = "<article><h1>News</h1><p>%s</p><p>Follow <b>us</b> everywhere.</p><div class=qx>%s</div><p>Also %d.</p></article>"
    got = texts(spark, lambda i: page % (body(i), long, i))
    assert all(got[i] == f"News\n{body(i).strip()}\nAlso {i}." for i in got)


def test_what_stands_in_an_articles_header(spark):
    page = "<header>Site</header><main><article><header><h1>T%d</h1><p class=dek>Standfirst %d</p></header><p>%s</p><footer>Filed under x%d</footer></article></main>"
    got = texts(spark, lambda i: page % (i, i, body(i), i))
    assert all(got[i] == f"T{i}\nStandfirst {i}\n{body(i).strip()}" for i in got)


def test_names_that_mislead(spark):
    """Names that only contain a word, and a named part that holds most of the text, stay; menus without a name go."""
    page = "<article><h4 class='social-history'>Life %d</h4><section class='related-work'><p>Others %d</p></section><div class='sidebar'><p>%s</p></div><div class=zz><a href=a>Link one %d</a> <a href=b>Link two %d</a></div></article>"
    got = texts(spark, lambda i: page % (i, i, body(i), i, i))
    assert all(got[i] == f"Life {i}\nOthers {i}\n{body(i).strip()}" for i in got)


def test_notices_and_comments_go(spark):
    """Varying text in parts whose names say what they are."""
    page = "<article><p>%s</p><div class='notice'><p>Notice %d</p></div><div id=comments><p>Reader %d says so</p></div><div class='newsletter-box'>Mail %d</div></article>"
    got = texts(spark, lambda i: page % (body(i), i, i, i))
    assert all(got[i] == body(i).strip() for i in got)


def test_frequent_texts_stay_in_a_summary():
    """Whatever the order of pages, and though most texts are there but once."""
    page = lambda i: f"<div><p>{'same' if i % 12 else f'own {i}'}</p>" + "".join(f"<p>{i} {j}</p>" for j in range(9)) + "</div>"
    for order in (range(400), reversed(range(400)), sorted(range(400), key=lambda i: i % 12 > 0), sorted(range(400), key=lambda i: i % 12 == 0)):
        total = None
        for i in order:
            one = wrapper_of(parse(page(i)))
            total = merge(total, one) if total else one
        slot = total[-1][0][-1][0]
        assert digest_of("same") in slot[8] and len(slot[8]) <= 48


def test_neither_order_nor_partitions_matter(spark):
    """A notice on 92 of 100 pages that the first, or the last, ones lack; another on too few."""
    page = "<article><h1>News</h1>%s<p>%s</p><p>Also %d.</p>%s</article>"
    rows = [(i, "http://host/", page % ("<div class=qx>We value what you read.</div>" * (i >= 16), body(i), i, "<p>On some pages.</p>" * (i >= 60))) for i in range(200)]
    rows += [(1000 + i, "http://other/", page % ("", body(i), i, "<p>Same end.</p>")) for i in range(5)]
    want = None
    for own in (rows, rows[::-1], rows[100:] + rows[:100]):
        for parts in (1, 3, 16):
            df = spark.createDataFrame(own, "page_id long, url string, html string").repartition(parts) if parts > 1 else spark.createDataFrame(own, "page_id long, url string, html string").coalesce(1)
            got = {r.page_id: r.text for r in extract(df).collect()}
            assert all("We value" not in got[i] and ("On some pages." in got[i]) == (i >= 60) and f"Also {i}." in got[i] for i in range(200))
            assert all("Same end." not in got[1000 + i] for i in range(5))
            want = want or got
            assert got == want
