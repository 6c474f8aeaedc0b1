"""Wrappers of hosts: alignment, decisions, whole pages."""

from __future__ import annotations

import json
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from folio.llm import wrappers
from folio.llm.wrappers import expression, merge, parse, regex


def shape(*pages):
    found = [expression(parse(p)[0]) for p in pages]
    out = found[0]
    for x in found[1:]:
        out = merge(out, x)
    return regex(out)


def test_groups_that_follow_themselves_are_repeated():
    assert shape("<ul><li>a<li>b<li>c</ul>") == "<html><ul>(<li>#</li>)+</ul></html>"
    assert shape("<h2>a</h2><p>x<p>y<h2>b</h2><p>z") == "<html>(<h2>#</h2>(<p>#</p>)+)+</html>"
    assert shape("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "<html><dl>(<dt>#</dt><dd>#</dd>)+</dl></html>"


def test_what_one_page_lacks_is_optional():
    a, b, c = "<h1>t</h1><p>x</p>", "<h1>t</h1><div class=ad>buy</div><p>x<p>y", "<div class='ad'>buy</div><p>z"
    assert shape(a, b) == "<html><h1>#</h1>(<div.ad>#</div>)?(<p>#</p>)+</html>"
    assert shape(a, b, c) == "<html>(<h1>#</h1>)?(<div.ad>#</div>)?(<p>#</p>)+</html>"
    assert shape("<ul></ul><p>x", "<ul><li>a<li>b</ul><p>x") == "<html><ul>(<li>#</li>)*</ul><p>#</p></html>"


def test_streams_are_balanced():
    tree, title = parse("<!DOCTYPE html><title>T &amp; U</title><!-- <p>no --><body><p>a <b>b<p>c<script>'</p>'</script></div><img alt='x > y'>d < e")
    assert title == "T &amp; U"
    blocks = [t for n, own in wrappers.texts(tree) for t, _ in own]
    assert blocks == ["a b", "c", "d < e"]


PAGE = """<!DOCTYPE html><html><head><title>{t}</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href=/>Site</a> slogan</header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, {t}</p></div><div id="sidebar"><p>Side text about {t}</p></div>
{main}
<form><p>Write to us</p><input name=q><button>Send</button></form>
<div class="comments"><h3>Comments</h3><ul><li>{t}: nice<li>more words of a reader about it</ul></div>
<aside>Related <a href=/c>c</a></aside><footer>&copy; Site</footer></body></html>"""


def page(k, wrap="<article>{}</article>", extra=""):
    blocks = [f"Heading {k}", f"First &amp; long paragraph of page {k}\n with <b>bold</b>&nbsp;words.", "item one", "item two", f"Last paragraph {k} of it."]
    body = f"<h1>{blocks[0]}</h1>{extra}<p>{blocks[1]}<ul><li>{blocks[2]}<li>{blocks[3]}</ul><div class='share'>Share this</div><p>{blocks[4]}</p>"
    want = "\n".join(" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks)
    return PAGE.format(t=f"title {k}", main=wrap.format(body)), want


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r for r in wrappers.extract(df).collect()}


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main id=m><header>{}</header></main>", "<div class=x0><div class=y>{}</div></div>"])
def test_main_text_of_one_host(spark, wrap):
    made = [page(k, wrap) for k in range(8)]
    got = extracted(spark, [(k, f"http://www.site.example/{k}", h) for k, (h, _) in enumerate(made)])
    assert {k: r.text for k, r in got.items()} == {k: w for k, (_, w) in enumerate(made)}
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_template_text_without_names_is_found_by_the_host(spark):
    """Without article, names or links, only the pages of the host together tell what is the template's."""
    rows, want = [], {}
    for k in range(9):
        body = f"Words number {k} of the text, which differ from page to page and are long enough."
        rows.append((k, "https://plain.example/x", f"<title>{k}</title><body><div><p>The very same long introduction of this site, on each of its pages.</p></div><div><h1>Page {k}</h1><p>{body}<p>{body} Again.</div><div>All rights are with the owner of this site and nobody else.</div>"))
        want[k] = f"Page {k}\n{body}\n{body} Again."
    assert {k: r.text for k, r in extracted(spark, rows).items()} == want


def test_copies_do_not_turn_into_template(spark):
    html = "<title>one</title><body><div class=q><h1>A story</h1><p>that is on many addresses, word for word the same.</p></div><div class=menu>Home</div>"
    got = extracted(spark, [(k, "https://copies.example/", html) for k in range(12)])
    assert {r.text for r in got.values()} == {"A story\nthat is on many addresses, word for word the same."}


def test_a_page_unlike_its_host_is_read_alone(spark):
    rows = [(k, "http://h.example/", page(k)[0]) for k in range(5)] + [(9, "http://h.example/", "<body><nav>Menu</nav><p>Only a paragraph, no article around it.</p></body>")]
    assert extracted(spark, rows)[9].text == "Only a paragraph, no article around it."


def test_many_rounds_give_one_wrapper_for_a_host(spark):
    """More different pages than one merge takes."""
    rows = [(k, "http://wide.example/p", "<body>" + "".join(f"<div class=c{chr(97 + j)}><p>x</p></div>" for j in range(7) if k >> j & 1) + f"<article><p>text {k}</p></article>") for k in range(128)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = wrappers.wrappers_of(df).collect()
    assert len(found) == 1 and found[0].pages == 128 and found[0].wrapper.count("<article>") == 1
    assert {r.page_id: r.text for r in wrappers.extract(df).collect()} == {k: f"text {k}" for k in range(128)}


def test_odd_rows(spark):
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    rows = [(1, None, None), (2, "no host", ""), (3, "http://a.example", "   "), (4, "http://a.example/", "<article>"), (5, "HTTP://B.example", deep), (6, "http://c.example", "<p" * 3000 + '"' * 3000),
            (7, "http://d.example", "<article><p>" + "long " * 200_000), (None, "http://e.example", "<article>kept &amp &quot;x&quot; &#233;</article>"), (8, "http://a.example", "<!-- open <article>x"), (8, "http://a.example", "<article>é  e</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "wrapper", "node", "text", "title", "pages", "decision")})
    got = {(r.page_id, r.text[:20]): r.n_chars for r in wrappers.extract(df).collect()}
    assert got == {(1, ""): 0, (2, ""): 0, (3, ""): 0, (4, ""): 0, (5, "deep text"): 9, (6, "<p" * 10): 9000, (7, "long " * 4): 5 * 200_000 - 1, (None, 'kept & "x" é'): 12, (8, ""): 0, (8, "é e"): 3}
    assert wrappers.extract(df.limit(0)).count() == 0


def test_wrappers_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = wrappers.wrappers_of(pages).collect()
    assert len(found) == pages.select(wrappers.host(F.col("url"))).distinct().count()
    assert sum(r.pages for r in found) == pages.count()
    assert json.loads(wrappers.infer(wrappers._pages(pages, "page_id", "url", "html")).first().wrapper)
