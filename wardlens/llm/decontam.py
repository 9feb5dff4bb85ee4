"""Benchmark decontamination with a distributed positional inverted index.

The index stores postings (document, position) of training tokens.  A test
window is ten consecutive words of a benchmark item.  Of each window, the
rarest terms by corpus count are its probes; only their postings are stored.
Each posting is adjusted by the term's offset in the item to the place where
the item would start, and the lists are intersected on (document, item,
start): a window whose probes all agree is a candidate.  Candidates are
compared word by word with the document, so that matches are exact phrases.
:func:`proximity_matches` asks for the same probes within a few places of each
other instead.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import Scratch, bounded, cut, words

WINDOW, PROBES = 10, 2


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents under (id, hash of the text): rows that agree in both are the same document."""
    return docs.select(F.col("doc_id").alias("doc"), text_hash().alias("h"), F.col("text"))


def test_items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct word sequences ``key, terms``, the items that have them ``key, item``); items without words are left out."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    rows = cut(rows.withColumn("key", F.xxhash64("terms")), "items")
    return cut(rows.select("key", "terms").distinct(), "item-terms"), rows.select("key", "item").distinct()


def test_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``key, at`` (first word), ``terms``: the windows; an item with fewer words is one window."""
    first = F.sequence(F.lit(0), F.greatest(F.size("terms") - size, F.lit(0)))
    return items.select("key", F.explode(F.transform(first, lambda i: F.struct(i.alias("at"), F.slice("terms", i + 1, size).alias("terms")))).alias("w")).select("key", "w.*")


def probe_terms(docs: DataFrame, windows: DataFrame, probes: int = PROBES) -> DataFrame:
    """``key, at, probes``: of each window, the ``probes`` rarest distinct terms (``term, offset`` in the item).

    Rarity is the term's count over all documents; a window with a term that
    no document has cannot occur and is dropped.
    """
    terms = windows.select("key", "at", F.posexplode("terms").alias("i", "term")).groupBy("key", "at", "term").agg(F.min(F.col("at") + F.col("i")).alias("offset"))
    vocabulary = bounded(cut(terms.select("term").distinct(), "vocabulary"))
    corpus = docs.select(F.explode(words(F.col("text"))).alias("term"))
    counts = cut(corpus.join(vocabulary, "term").groupBy("term").count(), "term-counts")
    # Ranking is within a window, which has ten terms at most.
    ranked = terms.join(bounded(counts), "term", "left").groupBy("key", "at").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "term", "offset"))).alias("t"))
    return ranked.where(F.col("t")[0]["n"] > 0).select("key", "at", F.transform(F.slice("t", 1, probes), lambda x: F.struct(x["term"].alias("term"), x["offset"].alias("offset"))).alias("probes"))


def adjusted_postings(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """Postings of the probes, moved to where their item would start: ``doc, h, key, start, offset``."""
    asked = cut(probes.select("key", F.explode("probes").alias("p")).select("key", "p.*").distinct(), "probes")
    index = _keyed(docs).select("doc", "h", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return index.join(bounded(asked), "term").select("doc", "h", "key", (F.col("pos") - F.col("offset")).alias("start"), "offset")


def candidates(postings: DataFrame, probes: DataFrame) -> DataFrame:
    """``doc, h, key, start, windows``: the windows whose probes all occur where the item would start."""
    # An item's windows and a document's agreeing probes of one item: both bounded by the item's length.
    asked = probes.groupBy("key").agg(F.collect_list(F.struct("at", F.transform("probes", lambda p: p["offset"]).alias("offsets"))).alias("asked"), F.min(F.size("probes")).alias("least"))
    agreed = postings.groupBy("doc", "h", "key", "start").agg(F.collect_set("offset").alias("got"))
    met = agreed.join(bounded(cut(asked, "asked")), "key").where(F.size("got") >= F.col("least"))
    return met.select("doc", "h", "key", "start", F.filter("asked", lambda w: F.size(F.array_except(w["offsets"], "got")) == 0).alias("windows")).where(F.size("windows") > 0)


def phrase_matches(docs: DataFrame, items: DataFrame, postings: DataFrame, probes: DataFrame, size: int = WINDOW) -> DataFrame:
    """Exact occurrences ``doc, h, key, start, n`` (``n`` words of the document from ``start``)."""
    found = candidates(postings, probes).select("doc", "h", "key", "start", F.explode("windows.at").alias("at"))
    found = cut(found.withColumn("pos", F.col("start") + F.col("at")).where("pos >= 0"), "candidates")
    # Each text is split once, for all places asked of it; there are at most as many as it has words.
    asked = cut(found.groupBy("doc", "h").agg(F.collect_set("pos").alias("places")), "candidate-docs")
    a, d = bounded(asked).alias("a"), _keyed(docs).alias("d")
    held = d.join(a, (F.col("d.h") == F.col("a.h")) & F.col("d.doc").eqNullSafe(F.col("a.doc"))).select("d.doc", "d.h", "d.text", "places")
    # Bound as a variable: an expression inside a lambda is computed for each element.
    at_places = F.transform(F.array(words(F.col("text"))), lambda w: F.transform("places", lambda p: F.struct(p.alias("pos"), F.slice(w, p + 1, size).alias("said"))))[0]
    said = held.dropDuplicates(["doc", "h"]).select("doc", "h", F.explode(at_places).alias("p")).select("doc", "h", "p.*").alias("s")
    each = found.alias("f").join(said, (F.col("f.h") == F.col("s.h")) & (F.col("f.pos") == F.col("s.pos")) & F.col("f.doc").eqNullSafe(F.col("s.doc")))
    each = each.select("f.doc", "f.h", "key", "f.pos", "at", "said").join(bounded(items), "key")
    # An item with fewer words is one window; at a document's end, fewer words are said.
    n = F.least(F.size("terms"), F.lit(size))
    same = F.slice("said", 1, n) == F.slice("terms", F.col("at") + 1, n)
    return each.where(same).select("doc", "h", "key", F.col("pos").alias("start"), n.alias("n")).distinct()


def proximity_matches(postings: DataFrame, probes: DataFrame, slop: int = 8) -> DataFrame:
    """``doc, h, key, at``: windows whose probes all occur at starts in one of the overlapping stretches of ``2 * slop`` places."""
    block = F.floor(F.col("start") / slop)
    near = postings.withColumn("start", F.explode(F.array(block, block - 1)))
    return candidates(near, probes).select("doc", "h", "key", F.explode("windows.at").alias("at")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, probes: int = PROBES) -> tuple[DataFrame, DataFrame]:
    """(exact matches ``doc, h, key, start, n``, the items of each key ``key, item``).

    ``doc`` is the ``doc_id`` and ``h`` the hash of the text, so repeated rows
    share their matches and null ids match by their text.  Null and empty
    texts, and items without words, have no matches.  An item without an id
    still marks words, but is not counted or named.  A long text is split once
    and read whole; what is asked of it grows with its words.  Other columns
    are not read, so their names cannot clash.
    """
    items, named = test_items(benchmark)
    asked = cut(probe_terms(docs, test_windows(items, size), probes), "window-probes")
    return cut(phrase_matches(docs, items, adjusted_postings(docs, asked), asked, size), "matches"), named


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.keep(cut(_contaminated(*decontaminate(docs, benchmark)), "contaminated"))
    every = _keyed(docs).select("doc", "h", F.size(words(F.col("text"))).cast("long").alias("n_words")).alias("e")
    found = bounded(found).alias("f")
    out = every.join(found, (F.col("e.h") == F.col("f.h")) & F.col("e.doc").eqNullSafe(F.col("f.doc")), "left")
    return out.select(
        F.col("e.doc").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def _contaminated(matches: DataFrame, items: DataFrame) -> DataFrame:
    """``doc, h, n_hit, items`` of the documents with a match."""
    hit = (matches.select("doc", "h", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos"))
           .distinct().groupBy("doc", "h").agg(F.count("*").alias("n_hit")))
    named = (matches.select("doc", "h", "key").distinct().join(items, "key").groupBy("doc", "h")
             .agg(F.array_sort(F.collect_set("item")).alias("items")))  # a document's items: as many as the benchmark has
    a, b = hit.alias("a"), named.alias("b")
    return a.join(b, (F.col("a.h") == F.col("b.h")) & F.col("a.doc").eqNullSafe(F.col("b.doc")), "left").select("a.doc", "a.h", "n_hit", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a match, with all their columns."""
    with Scratch(docs.sparkSession) as scratch:
        matches, _ = decontaminate(docs, benchmark)
        bad = scratch.keep(cut(matches.select("doc", "h").distinct(), "contaminated-docs"))
    bad = bounded(bad)
    rows = docs.select(text_hash().alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).alias("d")
    kept = rows.join(bad.alias("b"), (F.col("d.h") == F.col("b.h")) & F.col("row.doc_id").eqNullSafe(F.col("b.doc")), "left_anti")
    return kept.select("row.*")
