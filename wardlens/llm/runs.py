"""Periodic runs of words inside documents, by seeds and extension along diagonals.

A run is a longest stretch of consecutive words with smallest period q (words q
apart are equal) and a length of ``max(LEAST, 2 * q)`` or more.  On the diagonal
of lag q it is a stretch of matching words, ``max(LEAST - q, q)`` or more long.

Lags are handled by scales, from one power of two to the next.  A scale's least
stretch guarantees that a k-gram which starts at a multiple of ``step`` lies
inside it (``k + step - 1`` is at most that stretch), so only these k-grams are
looked up.  The index holds k-grams of one document that occur in it more than
once; the occurrences of a seed at the scale's lags are a range of its sorted
list.  There are at most ``lags / step`` a position, about two, so that a text
of one repeated word has as many seeds as any other.

The table of the furthest covered position of each lag is the sorted list of
(lag, position): a seed that starts where the one before it on its diagonal
still matches belongs to the same stretch and is not extended again.  What is
extended grows by less than a step on both sides, word by word in powers of
two.  Lags that are multiples of a run's period give the same stretch and are
left out.  The index names k-grams by numbers, not hashes, so all is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import map_arrow

#: A run's least length in words.
LEAST = 12
#: The first scale: lags up to 7, whose stretches have 6 words or more, with 4-grams at every third word.
FIRST_LAGS, FIRST_STEP, GRAM = 8, 3, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def word_lists(texts: list[str | None]) -> list[list[bytes]]:
    """The words of each text (runs without white space); ``bytes.split`` knows exactly the white space of the word rule."""
    return [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]


def index(names: np.ndarray, k: int) -> np.ndarray:
    """Names of the grams of ``2 * k`` words from those of ``k``; a gram that occurs once has a negative number of its own."""
    out = -1 - np.arange(len(names))
    at = np.flatnonzero((names[: -k or None] >= 0) & (names[k:] >= 0)) if len(names) > k else names[:0]
    if len(at):
        order = np.lexsort((at, names[at + k], names[at]))
        at = at[order]
        new = np.ones(len(at), bool)
        new[1:] = (names[at[1:]] != names[at[:-1]]) | (names[at[1:] + k] != names[at[:-1] + k])
        group = np.cumsum(new) - 1
        often = np.bincount(group)[group] > 1
        out[at[often]] = group[often]
    return out


def seeds(names: np.ndarray, place: np.ndarray, low: int, high: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """``lag, position`` of every looked-up gram (``place`` in its text is a multiple of ``step``) that occurs again at a lag from ``low`` to ``high - 1``."""
    at = np.flatnonzero(names >= 0)
    key = np.sort(names[at] * np.int64(len(names) + high + 1) + at)
    asked = at[place[at] % step == 0]
    base = names[asked] * np.int64(len(names) + high + 1)
    a, b = np.searchsorted(key, base + asked + low), np.searchsorted(key, base + asked + high)
    n = b - a
    first = np.repeat(asked, n)
    found = key[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())] - np.repeat(base, n)
    return found - first, first


def diagonals(levels: list[np.ndarray], lag: np.ndarray, at: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``lag, a, b`` of the stretches of matching words that hold the seeds."""
    order = np.lexsort((at, lag))
    lag, at = lag[order], at[order]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + step)  # not covered by the one before it
    head = np.flatnonzero(fresh)
    lag, a, b = lag[head], at[head].copy(), at[np.append(head[1:], len(at))[: len(head)] - 1] + k
    size = len(levels[0])

    def same(level: int, x: np.ndarray) -> np.ndarray:
        """Whether the grams of ``2 ** level`` words at ``x`` and a lag later are equal."""
        ok = (x >= 0) & (x + lag < size)
        x = np.where(ok, x, 0)
        names = levels[level]
        return ok & (names[x] >= 0) & (names[x] == names[np.where(ok, x + lag, 0)])

    for level in range((step - 1).bit_length() - 1, -1, -1):
        a -= np.where(same(level, a - (1 << level)), 1 << level, 0)
        b += np.where(same(level, b), 1 << level, 0)
    return lag, a, b


def find_runs(lists: list[list[bytes]], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, length, period`` of the runs of many texts at once, by text, start and period.

    Words of different texts have different names, so no gram reaches over a text's end.
    """
    sizes = np.array([len(x) for x in lists], np.int64)
    text = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    words = pd.factorize(np.array([w for x in lists for w in x], object))[0].astype(np.int64) if len(text) else text
    _, name, n = np.unique(text * np.int64(len(text) + 1) + words, return_inverse=True, return_counts=True)
    levels = [np.where(n[name] > 1, name, -1 - np.arange(len(name)))]  # levels[i]: grams of 2 ** i words
    found = [np.empty((3, 0), np.int64)]
    longest = int(sizes.max(initial=0))
    low, high, step, k = 1, FIRST_LAGS, FIRST_STEP, GRAM
    while 2 * low <= longest and longest >= least:
        while 1 << (len(levels) - 1) < k:
            levels.append(index(levels[-1], 1 << (len(levels) - 1)))
        names = levels[k.bit_length() - 1]
        if not (names >= 0).any():
            break  # longer grams do not repeat either
        lag, a, b = diagonals(levels, *seeds(names, place, low, high, step), k, step)
        good = b - a >= np.maximum(least - lag, lag)
        found.append(np.stack([a[good], b[good] + lag[good], lag[good]]))
        low, high = high, 2 * high
        step = k = low // 2
    start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[smallest], end[smallest], period[smallest]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    return text[start], place[start], end - start, period


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> str:
    """The words that no run repeats: a run keeps its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return b" ".join(w for w, n in zip(words, np.cumsum(edges).tolist(), strict=False) if n == 0).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The runs of every whole text, and the text without their repetitions.

    Returns ``id_col``, ``runs`` (an array of ``start, length, period`` in
    words, by start, then period) and ``collapsed`` (the words that are not in
    a run after its first period, joined by one space), a row per input row:
    repeated rows give equal rows, and null ids stay.  A null or empty text, or
    one of white space, has no runs and an empty ``collapsed``.  Runs may
    overlap.  Of ties nothing is dropped.  ``least`` is at least 10, which the
    smallest scale relies on.  Other columns are not read, so their names
    cannot clash.  A text is held whole by one task, with 8 bytes a word for
    each doubling of the length of its longest repeated gram; time grows as
    n log(n) with its words, also for one repeated word.
    """
    if least < 10:
        raise ValueError("least must be 10 or more")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            lists = word_lists(b.column(1).to_pylist())
            text, *run = find_runs(lists, least)
            ends = np.searchsorted(text, np.arange(len(lists) + 1))
            rest = [collapsed(words, *(x[i:j] for x in run)) if i < j else b" ".join(words).decode("utf-8", "surrogatepass") for words, i, j in zip(lists, ends, ends[1:], strict=False)]
            rows = pa.StructArray.from_arrays([pa.array(x) for x in run], names=["start", "length", "period"])
            yield {"_id": b.column(0), "runs": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows), "collapsed": pa.array(rest, pa.string())}

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_arrow(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), work, f"_id {kind}, runs {RUNS}, collapsed string")
    return out.withColumnRenamed("_id", id_col)


def run_digest(runs: DataFrame) -> DataFrame:
    """The rows of :func:`periodic_runs` with the number of runs, the longest one, and digests of all."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = runs.withColumn("best", best)
    length, period = -F.col("best.length"), F.col("best.period")
    return found.select(
        *[c for c in runs.columns if c not in ("runs", "collapsed")], F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * -best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted(text: Column, doc_id: Column) -> Column:
    """The text of the contract: in one of ten documents, by the checksum of the id, the words from some place on repeat."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        start = F.pmod(g, F.size(w))
        period = F.floor((F.size(w) - start) / (F.pmod(g, F.lit(8)) + 3)) + 1
        source = F.transform(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.when(i < start, i).otherwise(start + F.pmod(i - start, period)).cast("int"))
        return F.array_join(F.transform(source, lambda i: F.get(w, i)), " ")

    # Bound as a variable: an expression inside a lambda is computed for each element.
    once = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)))[0]
    return F.coalesce(F.when(h % 10 == 0, once), text)
