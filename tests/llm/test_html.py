import html
import re
import time

from tabulon.llm import queries
from tabulon.llm.html import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><h1>Site name, Inc.</h1></header><nav><ul><li><a href="/">Home, now.</a></li><li><a href="/x">About us.</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, many of them. Please accept, or go away.</p></div>
%s
<aside><p>Sidebar text that is quite long, with commas, and sentences. Really.</p></aside>
<div id="comments"><p>First! I disagree, strongly, with all of this. It is wrong.</p></div>
<form><p>Subscribe to our letter, please. It is free, always.</p><input></form><footer>&copy; 2020, all rights reserved.</footer></body></html>"""
ARTICLE = """<h1>A &amp; B</h1><p>The first   paragraph, with <b>bold</b> and a <a href="#">link</a>; it is long enough to count.</p>
<div class="ad">Buy now, cheap, today, only here!</div><p>The second&nbsp;one &#233;t cetera, has
two lines &lt;here&gt;, and ends.<p>An unclosed third, which is implied, and fine.</p><ul><li>item one</li><li>item two, too</li></ul>"""
WANT = "A & B\nThe first paragraph, with bold and a link; it is long enough to count.\nThe second one ét cetera, has two lines <here>, and ends.\nAn unclosed third, which is implied, and fine.\nitem one\nitem two, too"


def test_templates():
    for wrap in ("<article>%s</article>", "<main>%s</main>", '<div class="post"><div class="body">%s</div></div>', '<div id="content"><section>%s</section></div>'):
        got = main_text(PAGE % (wrap % ARTICLE)).replace("\xa0", " ")
        assert got == WANT, (wrap, got)


def test_pages_of_the_tables(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op10_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "just text, no markup."), (None, "u", "<script>x"), (6, "u", "<" * 5000), (7, "u", "<p>a" * 20000),
            (8, "u", "<div>" * 3000 + "deep text, here." + "</div>" * 3000), (9, "u", "<p>one, text.</p><!-- open <p>no</p>"), (9, "u", "&#0;&#xD800;&bogus; <p>kept, here.</p>")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = extract(table).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 10 and by[1] == by[2] == by[3] == by[None] == "" and by[4] == "just text, no markup."
    assert by[7].count("\n") == 19999 and by[8] == "deep text, here."
    assert extract(table.limit(0)).count() == 0


def test_long_pages_take_linear_time():
    n = 20_000
    for page in ("<a" * n, '<a href="x>' * n, "<b>x" * n, "<div>x" * n, "<svg/>x" * n, "</b>" * n, "<p>" + " " * n + "x"):
        start = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - start < 10, page[:9]


def test_deep_elements_keep_their_text():
    assert main_text("<div>" * 2000 + "deep, text here." + "</div>" * 2000 + "<nav>menu, no.</nav>") == "deep, text here."
    assert main_text("<div>" * 2000 + "<nav>menu, no.</nav><p>deep, text here.") == "deep, text here."


def test_references_and_classes():
    assert main_text("<p>&#" + "9" * 5000 + "; &#00000000065; x, y.</p>") == "\ufffd A x, y."
    assert main_text('<div class="w-1/2 body"><h2>Title</h2><p>A long enough paragraph, with a point.</p></div>') == "Title\nA long enough paragraph, with a point."


def test_class_names_bar_no_wrapper_of_the_article():
    for wrap in ("<article>%s</article>", "%s"):
        for name in ("content has-sidebar", "post with-sidebar", "container responsive", "no-nav", "legal", "page-form"):
            page = PAGE.replace("<body>", f'<body><div class="{name}">').replace("</body>", "</div></body>") % (wrap % f"<div>{ARTICLE}</div>")
            assert main_text(page).replace("\xa0", " ") == WANT, (wrap, name)
    table = '<div class="table-responsive"><table><tr><td>Of a table, one cell.</td><td>And, next, another.</td></tr></table></div>'
    assert main_text(PAGE % f"<article>{ARTICLE}{table}</article>").endswith("Of a table, one cell.\nAnd, next, another.")
    talk = '<div class="comments">' + "<p>I disagree, strongly, with all of this. It is wrong.</p>" * 40 + "</div>"
    assert main_text(PAGE % f"<article>{ARTICLE}</article>{talk}").replace("\xa0", " ") == WANT


def test_nested_names_take_linear_time():
    start = time.perf_counter()
    main_text('<div class="ad">x, y.' * 20_000)
    assert time.perf_counter() - start < 10
