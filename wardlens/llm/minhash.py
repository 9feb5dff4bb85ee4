"""Near-duplicate documents: an inverted join over signature coordinates.

A document is the set of its distinct word shingles.  Its signature has
:data:`COORDS` coordinates; the value of one is a hash of some independent
minimum hashes (:func:`rows_for`), so that two sets of similarity s agree in a
coordinate with probability s ** rows.  Documents are posted under each
(coordinate, value).  Pairs that agree in fewer than :data:`MATCHES`
coordinates are dropped, so only the first ``COORDS - MATCHES + 1`` coordinates
are posted (prefix); the others are counted from the signatures of the pairs
that a posting list brings together (skip).  What remains is confirmed on the
full shingle sets.  At the linking limit a pair is missed with probability
under :data:`MISSED` (3e-8 at 0.85, 6e-8 at 0.8), farther up hardly ever.

Equal sets are one node, so copies cost nothing.  A short posting list gives
its pairs.  A long one first gives only the links to its smallest member.
Members that this leaves outside the list's largest component are then
compared with the whole list, block by block inside the tasks, which return
only links that join two components.  So no such link is lost, and a group of
near copies never becomes rows for all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.llm.common import Scratch, bounded, cut, map_arrow
from wardlens.llm.components import connected_components
from wardlens.llm.hashing import BASE, MASK, mix, word_hashes

COORDS, MATCHES = 28, 2
#: The number of minimum hashes in a coordinate is the largest that misses a pair at the linking limit with less than this probability.
MISSED = 1e-6
#: Posting lists up to this length give all their pairs.
SHORT_LIST = 24
#: Members and shingles of a block of a long list, on average at most; two blocks at a time are compared in a task.
BLOCK_NODES, BLOCK_SHINGLES = 256, 400_000


@cache
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``n`` hash functions, from a fixed rule."""
    rule = np.random.Generator(np.random.PCG64(20240607))
    return rule.integers(1, MASK, n, np.uint64, endpoint=True) | np.uint64(1), rule.integers(0, MASK, n, np.uint64, endpoint=True)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; words are runs without white space, A-Z counted as a-z."""
    h, starts, _, offsets = word_hashes(texts)
    owner = np.searchsorted(offsets, starts, "right") - 1
    n = np.bincount(owner, minlength=len(texts)) if len(h) else np.zeros(len(texts), int)
    ends = np.cumsum(n)

    def join(length: int, parts: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(parts[0]), length, np.uint64)
        for x in parts:
            out = mix(out * np.uint64(BASE) + x)
        return out

    with np.errstate(over="ignore"):
        every = join(k, [h[i : len(h) - k + 1 + i] for i in range(k)]) if len(h) >= k else h[:0]
        out = []
        for size, end in zip(n.tolist(), ends.tolist(), strict=True):
            a = end - size
            out.append(np.unique(every[a : end - k + 1]) if size >= k else join(size, [h[i : i + 1] for i in range(a, end)]) if size else h[:0])
    return out


def rows_for(percent: int, coords: int = COORDS, matches: int = MATCHES) -> int:
    """The most minimum hashes a coordinate for which a pair at the limit agrees in ``matches`` coordinates with probability 1 - :data:`MISSED`."""
    def missed(rows: int) -> float:
        p = (percent / 100) ** rows
        return sum(comb(coords, i) * p**i * (1 - p) ** (coords - i) for i in range(matches))

    return max((r for r in range(1, 17) if missed(r) <= MISSED), default=1)


def signature(shingles: np.ndarray, coords: int, rows: int) -> np.ndarray:
    """``coords`` values of 63 bits; in blocks, so that memory does not grow with the text."""
    a, b = _hashes(coords * rows)
    low = np.full(coords * rows, MASK, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 2048):
            x = shingles[i : i + 2048, None] * a + b
            x ^= x >> np.uint64(31)
            low = np.minimum(low, (x * np.uint64(BASE)).min(axis=0))
        out = np.zeros(coords, np.uint64)
        for r in range(rows):
            out = mix(out * np.uint64(BASE) + low[r::rows])
    return out >> np.uint64(1)


def signatures(docs: DataFrame, k: int, rows: int, coords: int = COORDS) -> DataFrame:
    """``doc, n, set_id, sig`` of every row; ``set_id`` is a hash of the full set, null with an empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            sets = shingle_sets(b.column("text"), k)
            yield {"doc": b.column("doc"), "n": [len(s) for s in sets], "set_id": [set_name(s) for s in sets], "sig": [signature(s, coords, rows).astype(np.int64) if len(s) else None for s in sets]}

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc"), "text"), work, "doc bigint, n bigint, set_id string, sig array<bigint>")


def set_name(shingles: np.ndarray) -> str | None:
    return xxhash.xxh3_128_hexdigest(shingles.tobytes()) if len(shingles) else None


def near_enough(least: Column, most: Column, percent: int) -> Column:
    """The length filter: a set of ``least`` elements can reach the limit with one of ``most``."""
    return F.lit(100) * least >= F.lit(percent) * most


def posting_lists(nodes: DataFrame, coords: int, matches: int) -> DataFrame:
    """Members ``post, c, node, n, size`` of the posting lists with two members or more, under the prefix coordinates ``c``."""
    posts = nodes.select("node", "n", F.posexplode(F.slice("sig", 1, coords - matches + 1)).alias("c", "v")).select(F.xxhash64("c", "v").alias("post"), "c", "node", "n")
    sizes = posts.groupBy("post").agg(F.count("*").alias("size")).where("size > 1")
    return cut(posts.join(sizes, "post"), "postings")


def short_signature() -> Column:
    return F.transform("sig", lambda v: (v % (1 << 31)).cast("int")).alias("sig")


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc, text`` of the documents in ``wanted`` (``doc``); repeated rows stay."""
    return docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(bounded(wanted), "doc", "left_semi")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, matches: int) -> DataFrame:
    """Those of ``pairs`` (``a, b``) that agree in ``matches`` coordinates and whose full sets reach the limit."""
    sig = nodes.select("node", short_signature(), "set_id")
    both = pairs.distinct().join(sig.toDF("a", "sig_a", "set_a"), "a").join(sig.toDF("b", "sig_b", "set_b"), "b")
    same = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
    close = cut(both.where(same >= matches).select("a", "b", "set_a", "set_b"), "close-pairs")
    texts = cut(texts_of(cut(close.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "close-docs"), docs), "close-texts")
    dealt = close.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for x in batches:
            out = []
            names = (x.column(c).to_pylist() for c in ("a", "b", "set_a", "set_b"))
            for a, b, s, t, p, q in zip(*names, shingle_sets(x.column("text_a"), k), shingle_sets(x.column("text_b"), k), strict=True):
                if set_name(p) == s and set_name(q) == t:  # of rows that share an id, only one text stands for it
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        out.append((a, b))
            yield {"a": [a for a, _ in out], "b": [b for _, b in out]}

    return map_arrow(dealt.select("a", "b", "text_a", "text_b", "set_a", "set_b"), work, "a bigint, b bigint")


def joining_links(u: dict, v: dict, c: int, percent: int, matches: int) -> list[tuple[int, int]]:
    """The pairs of parts that links between two blocks of one list join.

    Blocks have ``node, part, n, sig`` and ``set``.  A pair is looked at in the
    list of the first coordinate in which it agrees, if it agrees in
    ``matches`` or more; links inside what earlier links join are left out.
    """
    n, m = u["n"][:, None], v["n"][None, :]
    todo = (u["part"][:, None] != v["part"][None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    same = np.zeros(todo.shape, np.int16)
    for i in range(u["sig"].shape[1]):
        equal = u["sig"][:, i, None] == v["sig"][None, :, i]
        if i < c:
            todo &= ~equal
            if not todo.any():
                return []
        else:
            same += equal
    todo &= same >= matches
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.get(x, x) != x:
            x = top[x]
        return x

    held: dict[tuple[int, int], set] = {}

    def elements(side: int, i: int) -> set:
        if (side, i) not in held:
            held[side, i] = set((u, v)[side]["set"][i].tolist())
        return held[side, i]

    out = []
    for i, j in np.argwhere(todo).tolist():
        a, b = root(int(u["part"][i])), root(int(v["part"][j]))
        if a != b:
            p, q = elements(0, i), elements(1, j)
            both = len(p & q)
            if 100 * both >= percent * (len(p) + len(q) - both):
                top[max(a, b)] = min(a, b)
                out.append((int(u["part"][i]), int(v["part"][j])))
    return out


def open_links(long: DataFrame, parts: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, matches: int) -> DataFrame:
    """The pairs of parts ``a, b`` that links of long lists join: whoever is outside a list's largest part meets the whole list."""
    owned = long.join(parts.withColumnRenamed("component", "part"), "node", "left").select("post", "c", "node", "n", F.coalesce("part", "node").alias("part"))
    sizes = owned.groupBy("post", "part").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    main = sizes.groupBy("post").agg(F.max(F.struct("k", "part")).alias("main"), F.count("*").alias("parts"), F.sum("k").alias("k"), F.sum("w").alias("w")).where("parts > 1")
    blocks = F.ceil(F.greatest(F.col("k") / BLOCK_NODES, F.col("w") / BLOCK_SHINGLES))
    members = cut(owned.join(main.select("post", F.col("main.part").alias("main"), blocks.alias("blocks")), "post"), "open-lists")
    texts = texts_of(cut(members.select(F.col("node").alias("doc")).distinct(), "open-docs"), docs).join(nodes.select(F.col("node").alias("doc"), short_signature(), "set_id"), "doc")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found, names = shingle_sets(b.column("text"), k), b.column("set_id").to_pylist()
            good = [i for i, (s, name) in enumerate(zip(found, names, strict=True)) if set_name(s) == name]
            yield {"node": b.column("doc").take(pa.array(good, pa.int64())), "sig": b.column("sig").take(pa.array(good, pa.int64())), "set": [found[i].tobytes() for i in good]}

    held = map_arrow(texts.select("doc", "text", "sig", "set_id"), sets, "node bigint, sig array<int>, set binary").dropDuplicates(["node"])
    full = members.join(held, "node").select("post", "c", "blocks", F.pmod(F.xxhash64("node"), "blocks").alias("block"), (F.col("part") != F.col("main")).alias("rest"), F.struct("node", "part", "n", "sig", "set").alias("x"))
    side = cut(full.groupBy("post", "c", "blocks", "block", "rest").agg(F.collect_list("x").alias("x")), "list-blocks")  # of one block
    # Each pair of blocks is a key of its own, so that a long list is spread over tasks.
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    u = side.where("rest").select("post", "c", F.col("block").alias("i"), every.alias("j"), F.col("x").alias("u")).repartition("post", "i", "j")
    v = side.select("post", every.alias("i"), F.col("block").alias("j"), "rest", F.col("x").alias("v")).repartition("post", "i", "j")
    meet = u.join(v, ["post", "i", "j"]).where(~F.col("rest") | (F.col("i") <= F.col("j")))  # two blocks outside the largest part meet once

    def read(x) -> dict:
        rows = x.values
        sets = [np.frombuffer(s, np.uint64) for s in rows.field("set").to_pylist()]
        numbers = {c: rows.field(c).to_numpy(zero_copy_only=False) for c in ("node", "part", "n")}
        return numbers | {"sig": rows.field("sig").flatten().to_numpy(zero_copy_only=False).reshape(len(sets), -1), "set": sets}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i in range(b.num_rows):
                found = joining_links(read(b.column("u")[i]), read(b.column("v")[i]), b.column("c")[i].as_py(), percent, matches)
                yield {"a": [a for a, _ in found], "b": [b for _, b in found]}

    return cut(map_arrow(meet.select("c", "u", "v"), work, "a bigint, b bigint"), "joined-parts")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, coords: int = COORDS, matches: int = MATCHES) -> DataFrame:
    """Group documents by links of similarity ``percent`` / 100 or more on ``k``-word shingles.

    Returns ``doc_id, n_shingles, component_id`` (the smallest id reachable,
    itself included), a row per input row.  A text with fewer words than ``k``
    is one shingle; one without words (or null) has none and is linked with
    nothing.  Rows that share an id are one document; if their texts differ,
    the one with the smallest set hash stands for it.  A row without an id is
    linked with nothing and has a null component.  Ids must be integers, else a
    ValueError is raised.  Long texts are read whole.  Other columns are not
    read, so their names cannot clash.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id must be an integer: a group is named by its smallest id")
    with Scratch(docs.sparkSession) as scratch:
        return scratch.keep(cut(_near_duplicates(docs, k, percent, coords, matches), "near-duplicates"))


def _near_duplicates(docs: DataFrame, k: int, percent: int, coords: int, matches: int) -> DataFrame:
    sigs = cut(signatures(docs, k, rows_for(percent, coords, matches), coords), "signatures")
    held = sigs.where(F.col("set_id").isNotNull() & F.col("doc").isNotNull())
    one = held.groupBy("doc").agg(F.min(F.struct("set_id", "n", "sig")).alias("s")).select("doc", "s.*")
    nodes = cut(one.groupBy("set_id").agg(F.min("doc").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")
    member = one.select("doc", "set_id").join(nodes.select("set_id", "node"), "set_id").select("doc", "node")

    lists = posting_lists(nodes, coords, matches)
    short = lists.where(F.col("size") <= SHORT_LIST)
    x, y = short.alias("x"), short.alias("y")
    pairs = x.join(y, (F.col("x.post") == F.col("y.post")) & (F.col("x.node") < F.col("y.node")) & near_enough(F.least("x.n", "y.n"), F.greatest("x.n", "y.n"), percent)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    long = cut(lists.where(F.col("size") > SHORT_LIST).select("post", "c", "node", "n"), "long-lists")

    def star(members: DataFrame) -> DataFrame:
        hub = members.groupBy("post").agg(F.min(F.struct("node", "n")).alias("hub"))
        return members.join(hub, "post").where((F.col("node") != F.col("hub.node")) & near_enough(F.least("n", "hub.n"), F.greatest("n", "hub.n"), percent)).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))

    parts = cut(connected_components(confirmed(pairs.union(star(long)), nodes, docs, k, percent, matches)), "components")
    if not long.isEmpty():
        joined = cut(connected_components(open_links(long, parts, nodes, docs, k, percent, matches)).toDF("component", "whole"), "joined")
        # A node without any link so far is a part by itself.
        new = joined.select(F.col("component").alias("node"), "component").join(parts, "node", "left_anti")
        parts = parts.union(new).join(joined, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    label = member.join(parts, "node", "left").select("doc", F.coalesce("component", "node").alias("component_id"))
    out = sigs.select("doc", "n").join(label, "doc", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id; all columns.

    Repeated rows of one id are one document and give one row (the one with
    the smallest text); rows without an id, and texts without words, stay.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id must be an integer: the smallest id of a group stays")
    with Scratch(docs.sparkSession) as scratch:
        groups = near_duplicates(docs, k, percent).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("id")).distinct()
        groups = scratch.keep(cut(groups, "dropped"))
        again = docs.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id")
        again = scratch.keep(cut(again.join(groups, "id", "left_anti"), "repeated"))
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(bounded(groups), "id", "left_anti")
    again = bounded(again)
    once, twice = rows.join(again, "id", "left_anti"), rows.join(again, "id", "left_semi")
    first = twice.groupBy("id").agg(F.min(F.struct(F.coalesce("row.text", F.lit("")).alias("text"), "row")).alias("s"))
    return once.select("row.*").unionByName(first.select("s.row.*"))
