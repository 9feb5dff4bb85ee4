"""HTML extraction: the articles of the given pages by a plain rule, blocks of odd and broken pages, the tree on pages it has not seen."""

from __future__ import annotations

import html
import re
import time

import pytest

from wardlens.llm import html_text, queries

SF = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string, text string, blocks int, words int, place string"


@pytest.fixture(scope="module")
def model(spark):
    return html_text.fit(spark)


def extract(spark, model, pages):
    rows = spark.createDataFrame([(i, f"u{i}", p, "t", 1, 2, "x") for i, p in enumerate(pages)], PAGES)
    got = {r.page_id: r for r in html_text.main_text(rows, model).collect()}
    assert all(r.n_chars == len(r.text) and r.url == f"u{i}" for i, r in got.items())
    return [got[i].text for i in range(len(pages))]


def test_given_pages(spark):
    def article(page):
        inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
        return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())

    given = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op13_html_text(spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert {r.page_id: r.text for r in got.collect()} == {i: article(p) for i, p in given.items()}


def test_blocks():
    cut = lambda p: [b[0] for b in html_text.text_blocks(p)]
    assert cut("<p>a<b>b</b> c<br>d&amp;&nbsp;e &lt;p&gt; &copy&#x41;</p>\n f ") == ["ab c d& e <p> ©A", "f"]
    assert cut("x<script>if (a</p>b) '</script ></div>y<style>p{}</style><!-- <p>no --><!--> z <!-- end") == ["x", "y z"]
    assert cut("a < b <3 <1> <p title='x>y' data-z=\"<p>\">c</p><p it's>d") == ["a < b <3 <1>", "c", "d"]
    assert cut("<select><option>no</select><textarea>no</p></textarea><template>no</template><div hidden>no<p>no</div>yes<svg><text>no</svg>") == ["yes"]
    assert cut("a<b") == ["a"] and cut("<title>a") == [] and cut("<?php a ?>b</>c</ d>e") == ["bce"]
    assert cut(None) == cut("") == cut(" \n ") == cut("<p></p>") == []
    assert cut("<ul><li>a<li>b<ul><li>c</ul>d</ul><table><tr><td>e<td>f<tr><th>g</table>") == list("abcdefg")
    assert [b[1:3] for b in html_text.text_blocks("<p>one <a href=x>two three</a> four</p><div><a>five</div>six <a>seven</a>")] == [(4, 2), (1, 1), (2, 1)]


def test_places():
    at = lambda p: {b[0]: b[3] for b in html_text.text_blocks(p)}
    assert at("a<nav>b</nav><article>c<header>d</header><aside>e<article>f</article></aside></article>g<header>h</header>") == {"a": -2, "b": -1, "c": 1, "d": 1, "e": -1, "f": -1, "g": -2, "h": -1}
    assert at("<body class='has-sidebar'><div class='main with-comments'>a<div class='post-comments'>b</div><form>c<article>d</article>e</form></div>") == {"a": -2, "b": -1, "c": -1, "d": 1, "e": -1}
    assert at("<p>a</p><div role=navigation>b</div>") == {"a": 0, "b": -1}
    assert at("<nav><a>b</nav><p>c") == {"b": -1, "c": 0}  # what a page does not close ends with its parent


LONG = "the quick brown fox jumps over the lazy dog and runs far away into the woods " * 3


def test_marked_pages(spark, model):
    junk = f"<header>Site <a>Home</a></header><div id='cookie-notice'><p>{LONG}</p></div><div class='advert'>{LONG}</div>"
    after = f"<section id=comments><article class=comment><p>{LONG}</p></article></section><aside><p>{LONG}</p></aside><form><p>{LONG}</p><input value=x></form><footer>{LONG}</footer>"
    body = f"<h1>Title</h1><p>{LONG}</p><p>Be.</p><ul><li><a href=x>one</a></li><li>two</li></ul><p>It &amp; <i>that</i>.</p>"
    want = f"Title {LONG.strip()} Be. one two It & that."
    pages = [junk + open_ + body + close + after for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class='entry-content'>", "</div>"), ("<div itemprop=articleBody>", "</div>"), ("<main><article>", "</article><div>more</div></main>"))]
    assert extract(spark, model, pages) == [want] * len(pages)


def test_unmarked_pages(spark, model):
    """Without any mark, word count and link density decide."""
    menu = "".join(f"<div><a href={i}>Item {i}</a></div>" for i in range(5))
    page = f"<html><body>{menu}<h2>A title of nine words stands here for us</h2><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><div><a>Next page</a></div><div>Copyright me</div></body></html>"
    got = extract(spark, model, [page, menu, menu * 3 + "<p>Tiny note</p>"])
    assert got == [" ".join(["A title of nine words stands here for us"] + [LONG.strip()] * 3), "", ""]


def test_edges(spark, model):
    assert extract(spark, model, [None, "", "  ", "<p>", "<article></article>"]) == [""] * 5
    rows = spark.createDataFrame([(None, None, "<article>x</article>", "", 0, 0, "")] * 2, PAGES)
    assert [tuple(r) for r in html_text.main_text(rows, model).collect()] == [(None, None, "x", 1)] * 2
    assert html_text.main_text(rows.where("false"), model).collect() == []


@pytest.mark.parametrize("part", ["<b>", "</b>", "<div>", "</p>", "<p>", "<a href='", "<!--", "<", "x ", "<p>x</p>", "<i class=ad>", '<x a="', "<li>", "<svg>"])
def test_long_pages_take_time_in_proportion(part):
    took = []
    for n in (10_000, 80_000):
        start = time.perf_counter()
        html_text.text_blocks("<article>" + part * n)
        took.append(time.perf_counter() - start)
    assert took[1] < 20 * took[0] + 0.3


def test_no_shuffle(spark, model):
    plan = html_text.main_text(spark.read.parquet(f"{SF}/pages.parquet"), model)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
