"""Line dedup by an exact set-similarity join.

A line is the set of its words (runs without white space, A-Z lower-cased).
Words are ordered from rare to frequent by their counts over all lines.  Two
sets of Jaccard similarity t or more share one of their first
``n - ceil(t * n) + 1`` words in that order (prefix filter), have sizes within
t of each other (length filter), and have enough words left after the shared
one (positional filter).  Parity sketches of 64 to 256 bits bound the number of
differing words from below before the full sets are compared.  Lines with an
earlier match are removed.

Counts are kept per bucket of a hash of the word, which bounds the table that
the workers get; any order of the words gives the same result.  A word whose
bucket counts one word occurs once, so it is left out of the postings.

Lines with equal sets are one entry of the join.  The postings are shuffled
once, by word.  Inside a posting list a line is compared with the earlier ones
until one passes the filters with room to spare, which is its candidate; one
candidate per line is compared in full.  Lines whose candidate fails, which the
sketches make rare, are compared with the weaker ones that passed.  So a line
with a match leaves early, and a group of near copies gives a pair for each
line, not for each two of them.  A
list of more than :data:`BLOCK` postings is cut into blocks, and each two
blocks are a group of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlens.llm.common import TOKEN, Scratch, arrow_rows, bounded, cut, map_arrow, map_batches
from wardlens.llm.hashing import BASE, mix, word_hashes

#: Similarity in hundredths; lines of fewer distinct words stay.
PERCENT, LEAST_WORDS = 80, 5
#: The least words with which every line that has a word takes part; the registered query and the pipeline use it.
EVERY_LINE = 1
#: Buckets of the word counts, and the highest count that is told apart.
BUCKETS, MOST = 1 << 20, (1 << 20) - 1
CHUNK = 1 << 12
#: Postings of a list that are compared as one group, at most (twice as many where two blocks meet).
BLOCK = 4096
#: Postings a worker holds at once, about, beside one group.
HELD = 1 << 16
#: Sets of up to so many words have a sketch of 64 bits, or 128; larger ones have 256.
SHORT, MIDDLE = 48, 100
#: A candidate ends a line's search in a list if at most this part of the words that may differ does by its sketch; so does the last of so many weaker ones.
STRONG, WEAK = 0.5, 4
#: A line: its document's id (the lowest number for null), text hash and place; "earlier" is the order of these.  Tables leave out the hash where no two rows share an id.
KEY = ("doc", "h", "at")


def line_key() -> tuple[Column, Column]:
    """(document, text hash) of a row of documents."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h")


def key_of(df: DataFrame) -> tuple[str, ...]:
    """The columns that name a line in ``df``."""
    return tuple(c for c in KEY if c in df.columns)


def ids_differ(docs: DataFrame) -> bool:
    """Whether no two rows have the same id; only the ids are read."""
    return docs.groupBy(line_key()[0]).count().where("count > 1").isEmpty()


def group_order(group: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """The order by ``group`` (ascending numbers from 0), then ``keys`` (64-bit integers), then place.

    One sort of numbers that hold the group, the high bits of the first key and the place; what these do not tell apart is sorted in full.
    """
    if not len(group):
        return np.empty(0, np.int64)
    low = len(group).bit_length()
    room = max(64 - low - max(int(group[-1]).bit_length(), 1), 0)
    first = keys[0].view(np.uint64) - keys[0].min().view(np.uint64)
    first >>= np.uint64(max(int(first.max()).bit_length() - room, 0))
    packed = (((group.astype(np.uint64) << np.uint64(room)) | first) << np.uint64(low)) | np.arange(len(group), dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << low) - 1)).view(np.int64)
    packed >>= np.uint64(low)
    same = packed[1:] == packed[:-1]
    tied = np.flatnonzero(same)
    tied = tied[np.logical_or.reduce([k[order[tied]] != k[order[tied + 1]] for k in keys])]  # equal keys are in their order
    if len(tied):
        run = np.concatenate(([0], np.cumsum(~same)))
        unsorted = np.zeros(run[-1] + 1, bool)
        unsorted[run[tied]] = True
        tied = np.flatnonzero(unsorted[run])
        those = order[tied]
        order[tied] = those[np.lexsort((those, *(k[those] for k in reversed(keys)), group[those]))]
    return order


def places_before(marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many ``marks`` are at or before each of the ``starts`` (both ascending); the marks are looked up, which are fewer."""
    return np.cumsum(np.bincount(np.searchsorted(starts, marks), minlength=len(starts))[: len(starts)])


def word_counts(docs: DataFrame) -> np.ndarray:
    """How many words of all documents fall into each bucket; at most :data:`MOST`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen, held, words = np.zeros(BUCKETS, np.int64), [], 0
        for b in batches:
            held.append((word_hashes(b.column(0))[0] & np.uint64(BUCKETS - 1)).astype(np.int32))
            words += len(held[-1])
            if words > BUCKETS:  # a count of all buckets costs as much as one of so many words
                seen += np.bincount(np.concatenate(held), minlength=BUCKETS)
                held, words = [], 0
        if held:
            seen += np.bincount(np.concatenate(held), minlength=BUCKETS)
        yield {"chunk": list(range(BUCKETS // CHUNK)), "n": [x.tobytes() for x in seen.reshape(-1, CHUNK)]}

    def add(batches: Iterator[dict]) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, n in zip(b["chunk"], b["n"], strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(n, np.int64)
        yield {"chunk": list(sums), "n": [x.tobytes() for x in sums.values()]}

    schema = "chunk int, n binary"
    parts = map_batches(map_arrow(docs.select("text"), count, schema).repartition("chunk"), add, schema).collect()  # BUCKETS numbers
    counts = np.zeros((BUCKETS // CHUNK, CHUNK), np.int64)
    for r in parts:
        counts[r["chunk"]] = np.frombuffer(r["n"], np.int64)
    return np.minimum(counts.ravel(), MOST).astype(np.int32)


def sketches(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Four lanes of parity bits of each set (words ``h`` from ``first`` on); short sets are folded into fewer lanes."""
    bit = np.uint64(1) << (h & np.uint64(63))
    out = [np.bitwise_xor.reduceat(bit, first) if len(first) else bit, *np.zeros((3, len(first)), np.uint64)]
    long = np.flatnonzero(n > SHORT)
    if len(long):
        those = np.repeat(n > SHORT, n)
        bit, lane, m = bit[those], (h[those] >> np.uint64(6)) & np.uint64(3), n[long]
        b = [np.bitwise_xor.reduceat(np.where(lane == i, bit, np.uint64(0)), np.cumsum(m) - m) for i in range(4)]
        middle, none = m <= MIDDLE, np.uint64(0)
        for lanes, x in zip(out, (np.where(middle, b[0] ^ b[2], b[0]), np.where(middle, b[1] ^ b[3], b[1]), np.where(middle, none, b[2]), np.where(middle, none, b[3])), strict=True):
            lanes[long] = x
    return out


def line_sets(docs: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``doc, h, at, s1, s2`` (hashes of the set), ``n, bits, more`` (sketch), ``skip, prefix`` of every line with ``least_words`` distinct words or more.

    ``prefix`` holds the keys of the first words but for the ``skip`` first, which occur once; a key is the count and a hash.
    """
    counts = docs.sparkSession.sparkContext.broadcast(word_counts(docs))

    def of(batch: pa.RecordBatch) -> dict:
        h, starts, data, offsets = word_hashes(batch.column("text"))
        breaks = np.flatnonzero(data == 10)
        owner = places_before(offsets, starts) - 1
        line = places_before(breaks, starts) + owner  # each text starts a line too
        key = (counts.value[(h & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.int64) << 43) | (h >> np.uint64(21)).astype(np.int64)
        order = group_order(line, key)
        key, line = key[order], line[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
        key, line, order = key[new], line[new], order[new]
        h = h[order]
        first = np.flatnonzero(np.diff(line, prepend=-1))  # of each line with words
        n = np.diff(first, append=len(line))
        place = np.arange(len(key)) - np.repeat(first, n)
        kept = n >= least_words
        with np.errstate(over="ignore"):
            if len(first):
                s1, s2 = np.add.reduceat(mix(h), first), np.add.reduceat(mix(h * np.uint64(BASE) + np.uint64(1)), first)
            else:
                s1 = s2 = h
        once = (key >> 43) <= 1
        in_prefix = place < np.repeat(n - -(-percent * n // 100) + 1, n)
        # At most n / (n + 1) similarity is left for a line whose set is not equal; if that is too little, the join by equal sets finds all.
        posted = in_prefix & ~once & np.repeat(kept & (100 * n >= percent * (n + 1)), n)
        number = np.repeat(np.arange(len(first)), n)
        sizes = np.bincount(number[posted], minlength=len(first))[kept]
        skip = np.bincount(number[in_prefix & once], minlength=len(first))[kept]
        doc, text_hash = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("h").to_numpy(zero_copy_only=False)
        o = owner[order[first]][kept]
        place_in_doc = line[first][kept] - (np.searchsorted(breaks, offsets[:-1]) + np.arange(len(offsets) - 1))[o]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(key[posted]))
        signed = lambda x: x[kept].view(np.int64)
        b = sketches(h, first, n)
        long = n[kept] > SHORT
        more = np.stack(b[1:], axis=1)[kept][long]
        ends = np.concatenate(([0], np.cumsum(long * more.itemsize * 3))).astype(np.int32)
        more = pa.Array.from_buffers(pa.binary(), len(long), [pa.array(long).buffers()[1], pa.py_buffer(ends), pa.py_buffer(more.tobytes())])
        return {"doc": doc[o], "h": text_hash[o], "at": place_in_doc.astype(np.int32), "s1": signed(s1), "s2": signed(s2), "n": n[kept].astype(np.int32), "bits": signed(b[0]), "more": more, "skip": skip.astype(np.int32), "prefix": lists}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        return map(of, batches)

    return map_arrow(docs.select(*line_key(), "text"), work, "doc bigint, h bigint, at int, s1 bigint, s2 bigint, n int, bits bigint, more binary, skip int, prefix array<bigint>")


def postings(entries: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """``word, doc, h, at, place, bits, more`` (``h`` if the entries have it): an entry under each word of its prefix; and the columns that tell the lists apart.

    ``place`` has the set's size, the word's position and a side, from the
    high bits on.  If there are long lists, a column ``part`` is 0, or numbers
    two blocks of a long list that meet; the side is 1 or 2 for the members of
    two different blocks, else 0.
    """
    key = key_of(entries)
    posts = entries.select(*key, "n", "bits", "more", "skip", F.posexplode("prefix").alias("i", "word"))
    place = F.shiftleft(F.col("n").cast("long"), 34).bitwiseOR(F.shiftleft((F.col("skip") + F.col("i")).cast("long"), 2))
    posts = posts.select("word", *key, place.alias("place"), "bits", "more")
    # A list cannot be longer than its word is frequent, so only lists of frequent words need to be counted.
    often = F.shiftright("word", 43) > BLOCK
    # The last word of a prefix is its most frequent.
    some = F.shiftright(F.get("prefix", F.size("prefix") - 1), 43) > BLOCK
    listed = entries.where(some).select(F.explode("prefix").alias("word"))
    long = listed.where(often).groupBy("word").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK)
    long = bounded(cut(long.select("word", F.ceil(F.col("k") / BLOCK).cast("long").alias("blocks")), "long-lists"))
    if long.isEmpty():
        return posts, ("word",)
    block = F.pmod(F.xxhash64(*key), F.col("blocks"))
    # Block b meets every block: as the first of two up to the last block, as the second from the first one on.
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(
        (F.least(block, j) * F.col("blocks") + F.greatest(block, j)).alias("part"),
        F.when(block == j, 0).when(block < j, 1).otherwise(2).cast("long").alias("side")))
    dealt = posts.where(often).join(long, "word", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("side")))
    split = dealt.select("word", F.explode(F.when(F.col("blocks").isNull(), whole).otherwise(meet)).alias("m"), *key, "place", "bits", "more")
    split = split.select("word", "m.part", *key, F.col("place").bitwiseOR(F.col("m.side")).alias("place"), "bits", "more")
    return posts.where(~often).withColumn("part", F.lit(0).cast("long")).unionByName(split), ("word", "part")


def _columns(t: pa.Table) -> dict[str, np.ndarray]:
    """The postings as arrays: ``n, pos, side`` from the place, the sketch's lanes ``b0 ... b3`` and their sum ``fold``."""
    x = {c: t.column(c).to_numpy() for c in t.column_names if c not in ("word", "part", "place", "bits", "more")}
    place = t.column("place").to_numpy()
    x |= {"n": place >> 34, "pos": (place >> 2) & 0xFFFFFFFF, "side": place & 3, "b0": t.column("bits").to_numpy().view(np.uint64)}
    more = t.column("more").combine_chunks()
    lanes = np.zeros((t.num_rows, 3), np.uint64)
    there = more.drop_null()
    if len(there):
        ends = np.frombuffer(there.buffers()[1], np.int32)[there.offset : there.offset + len(there) + 1]
        lanes[more.is_valid().to_numpy(zero_copy_only=False)] = np.frombuffer(there.buffers()[2].to_pybytes()[ends[0] : ends[-1]], np.uint64).reshape(-1, 3)
    x |= {f"b{i + 1}": lanes[:, i] for i in range(3)}
    x["fold"] = x["b0"] ^ x["b1"] ^ x["b2"] ^ x["b3"]
    return x


def _ordered(t: pa.Table) -> dict[str, np.ndarray]:
    """The columns of whole groups, with ``first``, where each starts, and ``order``, the rows with a group's lines in order."""
    new, x = np.concatenate(([True], _changes(t))), _columns(t)
    order = group_order(np.cumsum(new) - 1, *(x[c].astype(np.int64) for c in KEY if c in x))
    return x | {"order": order, "first": np.flatnonzero(new)}


def _changes(t: pa.Table) -> np.ndarray:
    """Whether each row but the first belongs to another group than the one before."""
    keys = [t.column(c).to_numpy() for c in ("word", "part") if c in t.column_names]
    return np.logical_or.reduce([k[1:] != k[:-1] for k in keys])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of some whole groups (word and part, if any) at a time; in the batches a group's rows follow each other."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= HELD:
            t = pa.Table.from_batches(held)
            before = np.flatnonzero(_changes(t))
            last = int(before[-1]) + 1 if len(before) else 0  # where the last group starts
            if last:
                yield _ordered(t.slice(0, last))
            held = t.slice(last).combine_chunks().to_batches()
            rows = t.num_rows - last
    if rows:
        yield _ordered(pa.Table.from_batches(held))


def differing(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(at least so many words differ, at most so many may) of the postings ``i`` and ``j``; what fails the other filters differs in more."""
    n, m = x["n"][i], x["n"][j]
    total, both = n + m, np.minimum(n, m)
    # Shared words s reach the limit if s * (100 + percent) >= percent * total; the words that differ are total - 2 * s.
    most = ((100 - percent) * total) // (100 + percent)
    left = np.minimum(n - x["pos"][i], m - x["pos"][j])  # the shared word and what follows
    differ = np.bitwise_count(x["fold"][i] ^ x["fold"][j]).astype(np.int64)
    differ[(100 * both < percent * (total - both)) | (left * (100 + percent) < percent * total)] = 1 << 40
    k = np.flatnonzero((differ <= most) & (both > SHORT))
    if len(k):
        b = [x[f"b{lane}"][i[k]] ^ x[f"b{lane}"][j[k]] for lane in range(4)]
        differ[k] = np.where(both[k] > MIDDLE, sum(np.bitwise_count(v).astype(np.int64) for v in b), np.bitwise_count(b[0] ^ b[2]).astype(np.int64) + np.bitwise_count(b[1] ^ b[3]))
    return differ, most


def most_of_all(n: np.ndarray, percent: int) -> np.ndarray:
    """In how many words a set of size ``n`` and any that is similar enough may differ, at most; 64 stands for all from there on."""
    largest = 100 * n // max(percent, 1)
    return np.minimum((100 - percent) * (n + largest) // (100 + percent), 64).astype(np.uint8)


def candidates(posts: DataFrame, percent: int, by: tuple[str, ...] = ("word",), every: bool = False) -> DataFrame:
    """Pairs ``doc_a, h_a, at_a, doc, h, at, n, strong, ended`` (the later line, with its size; ``h`` as in ``posts``) that pass the filters in one list.

    Each posting gives its line's earliest strong one, and the weak ones
    before that, up to the one that ``ended`` the search; with ``every``, those
    that are ``asked`` give all.  ``by`` tells the lists apart: the word alone
    where no list is cut into parts.
    """
    # Groups are brought together here; each is ordered when it is read, which takes one sort of numbers.
    ordered = posts.repartition(*by).sortWithinPartitions(*by)
    key = key_of(posts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for x in _groups(batches):
            first, order, rows = x["first"], x["order"], len(x["order"])
            # Places in the order: of the open postings, and of the next earliest of their lists, which they meet.
            own, other, found = np.arange(rows), np.repeat(first, np.diff(first, append=rows)), []
            if every:
                asked = x["asked"][order]
                own, other = own[asked], other[asked]
            fold, most = x["fold"][order], most_of_all(x["n"], percent)[order]
            weak = np.zeros(rows, np.int8)
            while (there := other < own).any():
                if not there.all():
                    own, other = own[there], other[there]
                # Nearly all pairs differ by their sketches in more than any partner may; only the others pass all filters.
                near = np.flatnonzero(np.bitwise_count(fold[other] ^ fold[own]) <= most[own])
                if len(near):
                    i, j = order[other[near]], order[own[near]]
                    differ, limit = differing(x, i, j, percent)
                    good = (differ <= limit) & ((x["side"][j] == 0) | (x["side"][i] != x["side"][j]))
                    if good.any():
                        strong = good & (differ <= STRONG * limit)
                        ended = strong.copy()
                        if not every:
                            weak[j] += good
                            ended |= weak[j] >= WEAK
                        found.append((i[good], j[good], strong[good], ended[good]))
                        if not every and ended.any():
                            open_ = np.ones(len(own), bool)
                            open_[near[ended]] = False
                            own, other = own[open_], other[open_]
                other = other + 1
            if found:
                i, j, strong, ended = map(np.concatenate, zip(*found, strict=True))
                yield {f"{c}_a": x[c][i] for c in key} | {c: x[c][j] for c in (*key, "n")} | {"strong": strong, "ended": ended}

    types = {c: "int" if c == "at" else "bigint" for c in key}
    return map_arrow(ordered, work, ", ".join([*(f"{c}_a {t}" for c, t in types.items()), *(f"{c} {t}" for c, t in types.items()), "n bigint, strong boolean, ended boolean"]))


def line_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc, h, at, s`` (``h`` as in ``pairs``): the text of each line that is in ``pairs``."""
    key = key_of(pairs)
    doc = key[:-1]
    wanted = cut(pairs.select(F.explode(F.array(F.struct(*key), F.struct(*[F.col(f"{c}_a").alias(c) for c in key]))).alias("k")).select("k.*").distinct(), "pair-lines")
    cases = bounded(cut(wanted.select(*doc).distinct(), "pair-docs"))
    texts = docs.select(*line_key(), "text").join(cases, list(doc), "left_semi")
    lines = texts.select(*doc, F.posexplode(F.split("text", "\n")).alias("at", "s")).join(bounded(wanted), list(key), "left_semi")
    return cut(lines.dropDuplicates(list(key)) if "h" in key else lines, "pair-texts")


def line_words(line: str) -> set[bytes]:
    """The words of a line (:data:`TOKEN`) in UTF-8; of bytes, ``lower`` changes A-Z alone and ``split`` knows white space of ASCII alone."""
    return set(line.encode().lower().split())


def verified(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (from :func:`cut`) whose full sets of words, from the ``lines`` of :func:`line_texts`, reach the limit: ``doc, h, at, n, doc_a, h_a``, the hashes as in ``pairs``."""
    key = key_of(pairs)
    given = [f"{c}_a" for c in key]
    both = lines.toDF(*given, "s").join(bounded(pairs), given).join(lines.toDF(*key, "t"), list(key))
    out = [*key, "n", *given[:-1]]

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        for x in batches:
            sets = [map(line_words, x[c]) for c in "st"]
            good = [i for i, (p, q) in enumerate(zip(*sets, strict=True)) if (100 + percent) * len(p & q) >= percent * (len(p) + len(q))]
            yield {c: [x[c][i] for i in good] for c in out}

    return map_batches(both.select(*out, "s", "t"), work, ", ".join(f"{c} {'int' if c == 'at' else 'bigint'}" for c in out))


def later_matches(docs: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc, h, at, n`` of every line that matches an earlier one, with ``doc_a, h_a``, the document of an earlier match.

    Lines are ordered by document id, text hash and place.  Where no two rows
    have the same id, ``h`` and ``h_a`` are left out here and on the way.
    """
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id must be an integer: earlier lines are those of smaller ids")
    with Scratch(docs.sparkSession) as scratch:
        single = ids_differ(docs)
        sets = line_sets(docs, percent, least_words)
        lines = cut(sets.drop("h") if single else sets, "line-sets")
        key = key_of(lines)
        line = F.struct(*key)
        # A set is represented by its earliest line.
        repeated = cut(lines.groupBy("s1", "s2").count().where("count > 1").select("s1", "s2"), "repeated-sets")
        copies = cut(lines.select(*key, F.col("n").cast("long").alias("n"), "s1", "s2").join(bounded(repeated), ["s1", "s2"]), "copied-lines")
        earliest = cut(copies.groupBy("s1", "s2").agg(F.min(line).alias("first")), "earliest-lines")
        least = bounded(earliest)
        equal = copies.join(least, ["s1", "s2"]).where(line != F.col("first")).select(*key, "n", *(F.col(f"first.{c}").alias(f"{c}_a") for c in key[:-1]))
        equal = cut(equal if single else equal.distinct(), "equal-lines")
        entries = lines.join(least, ["s1", "s2"], "left").where(F.col("first").isNull() | (line == F.col("first")))
        if not single:
            entries = entries.dropDuplicates(["s1", "s2"])  # repeated rows
        sets = entries.select(*key, "n", "bits", "more", "skip", "prefix")
        if not single or least is earliest:  # else each reader leaves the copies out by itself
            sets = cut(sets, "line-entries")
            scratch.drop(lines)

        posts, by = postings(sets)
        other = [f"{c}_a" for c in key]
        found = candidates(posts, percent, by).groupBy(*key, "n", *other).agg(F.max("strong").alias("strong"), F.max("ended").alias("ended"))
        with arrow_rows(docs.sparkSession, HELD):
            found = cut(found, "line-candidates")
        # The earliest strong candidate, or else the earliest, is compared first.
        chosen = F.min(F.struct(~F.col("strong"), *other)).alias("a")
        pairs = cut(found.groupBy(*key, "n").agg(chosen, F.max("ended").alias("ended")).select(*key, "n", *(f"a.{c}" for c in other), "ended"), "line-pairs")
        texts = line_texts(found, docs)
        near = cut(verified(pairs.drop("ended"), texts, percent), "line-matches")
        failed = cut(pairs.select(*key, "ended").join(near, list(key), "left_anti"), "line-open")
        if not failed.isEmpty():
            rest = found.drop("strong", "ended").join(failed.drop("ended"), list(key), "left_semi").join(pairs, [*key, *other], "left_anti")
            more = _earliest(verified(cut(rest, "line-rest"), texts, percent))
            near = near.union(cut(more, "line-more-matches"))
            # Where all that was noted fails, a search has ended too early; such a line is compared with all.
            again = cut(failed.where("ended").join(near, list(key), "left_anti").select(*key, F.lit(True).alias("asked")), "line-again")
            if not again.isEmpty():
                again = bounded(again)
                words = cut(sets.join(again, list(key), "left_semi").select(F.explode("prefix").alias("word")).distinct(), "line-again-words")
                marked = posts.join(bounded(words), "word", "left_semi").join(again, list(key), "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
                every = cut(candidates(marked, percent, by, every=True).drop("strong", "ended").distinct(), "line-again-pairs")
                near = near.union(_earliest(verified(every, line_texts(every, docs), percent)))
        return scratch.keep(cut(equal.union(near), "line-removals"))


def _earliest(matches: DataFrame) -> DataFrame:
    """One match a line."""
    key = key_of(matches)
    other = [f"{c}_a" for c in key[:-1]]
    return matches.groupBy(*key, "n").agg(F.min(F.struct(*other)).alias("a")).select(*key, "n", "a.*")


def dedup_lines(docs: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, one_source: int | None = None) -> DataFrame:
    """Remove lines that match an earlier line of any document.

    Returns the rows of ``docs`` with all their columns, ``text`` without the
    removed lines, and ``n_lines, n_removed`` added (columns of these names are
    replaced; other names cannot clash).  Earlier: smaller document id (null
    first), then smaller text hash, then place.  Matching: Jaccard similarity
    of the word sets, in hundredths ``percent`` or more, whether the earlier
    line itself stays or not.  Lines with fewer than ``least_words`` distinct
    words stay.  Repeated rows (equal id and text) are one document and lose
    the same lines.  A null text stays null, with 0 lines; an empty text has 1.
    Very long texts and lines take part whole; a line is held by one worker.
    Ids must be integers, else a ValueError is raised.

    With ``one_source``, a document goes altogether if so many hundredths of
    its words or more are in removed lines that matched one other document
    (the distinct words of these lines, against those of all removed lines and
    the words of the rest): it is a copy, of which only scraps are left.
    """
    matches = later_matches(docs, percent, least_words)
    doc = key_of(matches)[:-1]
    if one_source is None:
        gone = matches.groupBy(*doc).agg(F.collect_list("at").alias("gone"))
    else:
        # A document's removed lines, by the document they matched.
        gone = matches.groupBy(*doc, *(f"{c}_a" for c in doc)).agg(F.collect_list("at").alias("at"), F.sum("n").alias("n"))
        other = F.struct(*(f"{c}_a" for c in doc)) != F.struct(*doc)
        gone = gone.groupBy(*doc).agg(F.flatten(F.collect_list("at")).alias("gone"), F.sum("n").alias("n_gone"), F.coalesce(F.max(F.when(other, F.col("n"))), F.lit(0)).alias("from_one"))
    gone = bounded(cut(gone, "removed-lines"))
    base = docs.drop("n_lines", "n_removed")
    keyed = base.select(*line_key(), F.struct(*[F.col(f"`{c}`") for c in base.columns]).alias("row"))
    joined = keyed.join(gone, list(doc), "left")
    given = F.col("row.text")
    parts = F.split(given, "\n")

    def rest_of(parts: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "gone")
        return F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")

    # The lines are bound as a variable: an expression inside a lambda is computed for each element.
    text = F.when(F.col("gone").isNull(), given).otherwise(F.transform(F.array(parts), rest_of)[0])
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed")
    n_lines = F.coalesce(F.octet_length(given) - F.octet_length(F.replace(given, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines")
    out = joined.select(text.alias("text"), n_lines, n_removed, "row", "gone", *(["n_gone", "from_one"] if one_source is not None else []))
    if one_source is not None:
        rest = F.size(F.array_remove(F.split("text", TOKEN.replace("^", "")), ""))
        out = out.where(F.col("gone").isNull() | (100 * F.col("from_one") < one_source * (F.col("n_gone") + rest)))
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in base.columns], "n_lines", "n_removed")
