"""Main text of web pages from flat text blocks, classified by a decision tree.

A page is cut into a flat list of text blocks at the tags that start or end a
line on the screen.  A block has its words, how many of them are linked, and
its place: inside what the page marks as its article, inside what it marks as
something else (a menu, a footer, an advert), or neither.  A decision tree
reads the word count and link density of a block and its two neighbours, with
the place, and says whether the block belongs to the article.

The tree is trained by Spark on a small labelled table: :data:`LAYOUTS`, whose
words say what they are.  It is then one nested CASE over the array of a page's
blocks, so that a page never leaves its row and nothing is shuffled.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm.common import cut, map_arrow

BLOCKS = "array<struct<text:string,words:int,linked:int,place:int>>"
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "place")
DEPTH, LEAST_BLOCKS = 6, 2

# Tags that start or end a block, whose text is not shown, or that cannot hold any.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript object ol optgroup option p pre search section select summary svg table tbody td template tfoot th thead tr ul".split())
RAW_TAGS = frozenset("script style textarea title iframe xmp noembed noframes".split())
UNSEEN_TAGS = frozenset("noscript template svg select button object".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that end an open one of their group.
GROUPS = {"li": "li", "p": "p", "dt": "d", "dd": "d", "tr": "tr", "td": "cell", "th": "cell", "option": "option"}
#: Places by tag, and by the words of a class, an id or a role.
ARTICLE_TAGS = {"article": 3, "main": 1}
ARTICLE_WORDS = {"articlebody": 2, "article": 2, "post": 2, "entry": 2, "story": 2, "content": 1, "main": 1}
OTHER_TAGS = frozenset("nav aside footer dialog menu search".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal dialog alert alertdialog "
    "sidebar complementary menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar share sharing social related recommended "
    "comment comments disqus reply replies newsletter subscribe subscription signup login search footer contentinfo copyright masthead skip widget".split())
#: A class name with one of these says what is elsewhere or missing.
RELATIONS = frozenset("has with without no not free".split())

TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|!--(?:-?>|.*?(?:--!?>|\Z))|[!?/][^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|$))""", re.I)
NAME = re.compile(r"[A-Za-z]+")
RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW_TAGS}

#: The labelled table: a page per string.  K12 stands for 12 words of the article, D3 for 3 other words.
LAYOUTS = (
    # The article is marked, the rest partly.
    "<nav><ul><li><a>D1</a></li><li><a>D1</a></li><li><a>D1</a></li></ul></nav><div class='ad'>D9</div><article><h1>K8</h1><p>K40</p><p>K2</p><p>K60</p></article><footer>D14</footer>",
    "<header>D6</header><div>D12</div><article><h1>K5</h1><p>K3</p><p>K1</p></article><div>D30</div><footer>D10</footer>",
    "<div class='cookie'>D25 <a>D2</a></div><article><h2>K6</h2><ul><li>K4</li><li><a>K3</a></li><li>K5</li></ul><p>K50</p><aside>D20</aside><p>K30</p></article><section class='comments'><p>D35</p><p>D50</p></section>",
    "<main><p>D8</p><article><p>K70</p><p><a>K2</a> K20</p><blockquote>K15</blockquote></article><p>D40</p></main>",
    "<div class='sidebar'><p>D30</p><ul><li><a>D4</a></li><li><a>D5</a></li></ul></div><div class='post'><h1>K7</h1><p>K45</p><p>K5</p></div><form><label>D2</label><p>D10</p></form>",
    "<main><h1>K4</h1><p>K30</p><p>K4</p><table><tr><td>K1</td><td>K2</td></tr></table></main><div>D3</div><div>D20</div>",
    # Only the rest is marked.
    "<div class='menu'><a>D2</a></div><div class='menu'><a>D1</a></div><div><p>K35</p><p>K50</p><p>K40</p></div><div class='footer'>D12</div>",
    "<nav><a>D3</a></nav><h1>K7</h1><p>K28</p><p>K60</p><p>K22</p><div class='comments'><p>D40</p><p>D18</p></div>",
    # Nothing is marked.
    "<div><a>D1</a></div><div><a>D1</a></div><div><a>D2</a></div><h1>K9</h1><p>K40</p><p>K55</p><p>K33</p><div><a>D2</a></div><div>D3 <a>D1</a></div>",
    "<div><a>D2</a> D1 <a>D2</a></div><div>D2</div><p>K38</p><p>K25 <a>K2</a> K10</p><p>K44</p><div><a>D6</a></div><div><a>D5</a></div><div>D4</div>",
    "<div>D3</div><p>K60</p><p>K18</p><p>K80</p><ul><li><a>D3</a></li><li><a>D4</a></li><li><a>D2</a></li></ul><div>D5</div>",
    "<ul><li><a>D1</a></li><li><a>D1</a></li></ul><p>D4</p><ul><li><a>D6</a></li><li><a>D5</a></li></ul><p>D3 <a>D2</a></p>",
)
#: Each layout is taken with its word counts multiplied by these.
SCALES = (0.5, 1, 2, 4)


def labelled_pages() -> list[tuple[int, str]]:
    """The labelled table: number and HTML; a word is ``keep`` or ``drop``."""
    def words(scale: float):
        return lambda m: " ".join(["keep" if m[1] == "K" else "drop"] * max(1, round(int(m[2]) * scale)))

    return list(enumerate(re.sub(r"\b([KD])(\d+)", words(s), page) for page in LAYOUTS for s in SCALES))


def place_of(tag: str, attributes: str, inside: tuple[int, int]) -> tuple[int, int]:
    """(article, other) of an element inside one with ``inside``: how strongly it is marked as the article; whether as something else (2: not shown)."""
    article, other = inside
    names = [(k.lower(), a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)] if attributes else ()
    marks = {w for k, v in names if k != "hidden" for name in v.lower().split() if not RELATIONS & (parts := set(NAME.findall(name))) for w in parts}
    article = max(article, ARTICLE_TAGS.get(tag, 0), *(ARTICLE_WORDS.get(w, 0) for w in marks), 0)
    if tag in UNSEEN_TAGS or any(k == "hidden" for k, _ in names):
        return article, 2
    if tag in ("html", "body"):
        return article, other
    if other < 0:  # inside a form, which may hold a whole page
        other = 0 if tag in ARTICLE_TAGS else other
    if not other:
        if tag in OTHER_TAGS or OTHER_WORDS & marks or (tag == "header" and not article):
            other = 1
        elif tag == "form":
            other = -1
    return article, other


def text_blocks(page: str | None) -> list[tuple[str, int, int, int]]:
    """(text, words, linked words, place) of the blocks of a page; in time linear in its length.

    Place: 1 inside the article (the most strongly marked part of the page),
    -1 inside something else, -2 outside the article of a page that has one, 0
    where the page marks neither.  Character references are decoded, white
    space is one space.  What a broken page never closes ends with its parent.
    """
    out: list[tuple[str, int, int, tuple[int, int]]] = []
    stack: list[tuple[str, tuple[int, int]]] = []
    open_tags: dict[str, int] = {}
    said: list[str] = []
    here, linked, link_from = (0, 0), 0, -1
    page, at = page or "", 0

    def flush() -> None:
        nonlocal linked
        if said:
            words = "".join(said).split()
            if words and here[1] != 2:
                out.append((" ".join(words), len(words), min(linked, len(words)), here))
            said.clear()
        linked = 0

    def close() -> None:
        nonlocal here, link_from
        open_tags[stack.pop()[0]] -= 1
        here = stack[-1][1] if stack else (0, 0)
        if link_from > len(stack):
            link_from = -1

    def say(text: str) -> None:
        nonlocal linked
        text = entities.unescape(text) if "&" in text else text
        said.append(text)
        if link_from >= 0:
            linked += len(text.split())

    while at < len(page):
        less = page.find("<", at)
        if less < 0:
            say(page[at:])
            break
        if less > at:
            say(page[at:less])
        m = TAG.match(page, less)
        if not m:
            if page[less + 1 : less + 2].isalpha() and page[less + 1].isascii():
                break  # a tag that never ends
            say("<")
            at = less + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag
            if tag == "a":
                link_from = -1
            if open_tags.get(tag):
                flush()
                while stack[-1][0] != tag:
                    close()
                close()
            elif tag in BLOCK_TAGS:
                flush()
            continue
        if tag in RAW_TAGS:
            end = RAW_ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            said.append(" ")
            continue
        if tag in VOID_TAGS:
            if tag in BLOCK_TAGS:
                flush()
            continue
        inner = place_of(tag, m[3], here)
        if tag in BLOCK_TAGS or inner != here:
            flush()
            if stack and (stack[-1][0] == "p" and tag in BLOCK_TAGS or tag in GROUPS and GROUPS.get(stack[-1][0]) == GROUPS[tag]):
                close()
                inner = place_of(tag, m[3], here)
            stack.append((tag, inner))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            here = inner
        if tag == "a":
            link_from = len(stack)
    flush()
    most = max((article for *_, (article, other) in out if not other), default=0)

    def place(article: int, other: int) -> int:
        return -1 if other else (1 if article == most else -2) if most else 0

    return [(t, n, k, place(*p)) for t, n, k, p in out]


def page_blocks(pages: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """``blocks`` of every page, with the columns ``keep``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found = [text_blocks(t) for t in b.column(len(keep)).to_pylist()]
            yield {"blocks": [[dict(zip(("text", "words", "linked", "place"), x, strict=True)) for x in f] for f in found]} | {f"_{i}": b.column(i) for i in range(len(keep))}

    names = [f"_{i}" for i in range(len(keep))]
    given = pages.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col).alias("_text"))
    schema = ", ".join(f"{n} {pages.schema[c].dataType.simpleString()}" for c, n in zip(keep, names, strict=True))
    return map_arrow(given, work, f"{schema}, blocks {BLOCKS}").withColumnsRenamed(dict(zip(names, keep, strict=True)))


def block_features(blocks: Column, b: Column, i: Column) -> list[Column]:
    """:data:`FEATURES` of the block ``b`` at ``i``; a neighbour that is not there has no words."""
    def of(x: Column) -> list[Column]:
        return [F.coalesce(x["words"], F.lit(0)).cast("double"), F.coalesce(x["linked"] / x["words"], F.lit(0.0))]

    before = F.when(i > 0, F.get(blocks, i - 1))
    return [*of(b), *of(before), *of(F.get(blocks, i + 1)), b["place"].cast("double")]


def fit(spark: SparkSession, depth: int = DEPTH, least: int = LEAST_BLOCKS) -> DecisionTreeClassificationModel:
    """The decision tree, trained on the labelled table (some 450 blocks)."""
    pages = spark.createDataFrame(labelled_pages(), "page_id int, html string")
    blocks = page_blocks(pages, "html", "page_id")
    rows = blocks.select(F.explode(F.transform("blocks", lambda b, i: F.struct(
        F.array(*block_features(F.col("blocks"), b, i)).alias("x"), F.startswith(b["text"], F.lit("keep")).cast("double").alias("label")))).alias("r"))
    train = cut(rows.select("r.*").coalesce(1), "labelled-blocks").select(array_to_vector("x").alias("features"), "label")  # read once for each level of the tree
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=least, maxBins=256, seed=7).fit(train)


def tree_column(model: DecisionTreeClassificationModel, features: list[Column]) -> Column:
    """Whether the tree says 1, as one nested CASE."""

    def of(node) -> Column:
        if node.numDescendants() == 0:
            return F.lit(node.prediction() == 1.0)
        split = node.split()
        return F.when(features[split.featureIndex()] <= split.threshold(), of(node.leftChild())).otherwise(of(node.rightChild()))

    return of(model._call_java("rootNode"))


def main_text(pages: DataFrame, model: DecisionTreeClassificationModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: the blocks that the tree keeps, in page order, joined by one space.

    Returns ``id_col, url_col, text`` and ``n_chars`` (code points), a row per
    input row; repeated rows give equal rows, and null ids or addresses stay.
    A null or empty page, or one without text, has an empty text.  A page is
    read whole, however long; what it never closes ends at its end.  Of the
    article nothing is dropped, short lines and lists of links included; a
    ``header`` counts as a page's header unless it lies in the article.  Other
    columns are not read, so their names cannot clash.
    """
    blocks = page_blocks(pages, html_col, id_col, url_col)
    kept = F.filter("blocks", lambda b, i: tree_column(model, block_features(F.col("blocks"), b, i)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), " ")
    out = blocks.select(id_col, url_col, text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
