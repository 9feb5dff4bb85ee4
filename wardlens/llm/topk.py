"""Exact top-k inner-product search by a three-phase uniform threshold.

The dimensions are dealt out to :data:`PARTS` parts; a part holds its own
columns of all vectors and queries, and knows only its share of a score.

1. Every part sends each query's k highest shares of every block of vectors,
   and the lowest and highest share.  The vectors they name are scored in full;
   the k-th best of these scores is a safe lower bound of the k-th score.
2. Measured from a part's lowest share, in units of its range, shares are alike
   in all parts.  Every part gets the same threshold in these units, so that
   the thresholds add up to the bound: a vector that stays below it in all
   parts cannot be among the k best, so the entries at or above it suffice.
   Their sums are bounds from below and above, which leave few vectors.
3. What remains is resolved by whole inner products.

Vectors and queries are held in blocks of bounded size.  The queries, the
smaller side, are sent to every block of vectors.  Entries are places in a pair
of blocks, laid in arrays, and are looked up in the whole vectors of the block;
they are not joined with vectors one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import cut, map_arrow
from wardlens.llm.negatives import SCORES, STEP, beside, column, first_of, highest, matrix, packed

K, PARTS, SCALE = 10, 2, 1024
QUERY_BLOCK, VECTOR_BLOCK = 512, 8192
#: Blocks of a large table have more rows, up to these.
MOST_QUERIES, MOST_VECTORS = 4096, 16384
#: Shares of entries are kept in 32 bits, of which this is the relative error at most.
ROUNDED = 2.0**-23
#: Scores are exact while the squared lengths of scaled vectors stay below this.
MOST = 1 << 53


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``row, id, copy, v``: floor(scale * x) of each component; ``copy`` tells repeated rows apart.

    Left out: null ids, null vectors, and vectors with a null, NaN or infinite component.
    """
    x = F.col("embedding")
    rows = embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(
        F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))
    rows = rows.groupBy("id", "v").agg(F.count("*").alias("k"))
    rows = rows.select("id", "v", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("copy"))
    return cut(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _measure(rows: DataFrame) -> tuple[int, int]:
    """(number of rows, the longest vector's size); an error if scores could be inexact."""
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    n, size, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    if (most or 0.0) >= MOST:  # a score is at most the product of two lengths
        raise ValueError(f"squared length {most} of a scaled vector: scores are exact below {MOST} only")
    return n, size or 0


def _met(pairs: DataFrame, dims: list[tuple[int, int]], pick: Callable, schema: str) -> DataFrame:
    """``pick(row, part, first, end, shares)`` of every block of queries with every block of vectors of the part: shares are integers.

    A query does not meet its own row.  The dicts of one pair of blocks are laid end to end, with ``part``, ``block`` and ``grp``.
    """
    sizes = [size for _, size in dims]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, right = None, None
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r] for c in b.schema.names}
                part, block = row["part"].as_py(), row["block"].as_py()
                if (part, block) != now:
                    now, right = (part, block), matrix(row["x"], sizes[part]).T
                left, own, rows = matrix(row["a"], sizes[part]), column(row["a"], "own"), column(row["x"], "row")
                step = max(1, min(STEP, SCORES // max(1, right.shape[1])))
                got = []
                for i in range(0, len(left), step):
                    shares = left[i : i + step] @ right
                    shares[own[i : i + step, None] == rows] = -np.inf
                    got.append(pick(row, part, i, i + step, shares))
                yield {"part": [part], "block": [block], "grp": [row["grp"].as_py()]} | {c: [np.concatenate([g[c] for g in got])] for c in got[0]}

    return map_arrow(pairs, work, f"part int, block int, grp int, {schema}")


def _whole(pairs: DataFrame, size: int, work_on: Callable, schema: str) -> DataFrame:
    """``work_on(row, parts, score)`` of every block of queries with the block of vectors some parts have named entries of; ``score(i, j)`` gives whole inner products."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, right = None, None
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r] for c in b.schema.names}
                block = row["block"].as_py()
                if block != now:
                    now, right = block, matrix(row["x"], size)
                left = matrix(row["a"], size)

                def score(i: np.ndarray, j: np.ndarray, left: np.ndarray = left, right: np.ndarray = right) -> np.ndarray:
                    per = max(1, SCORES // max(1, size))
                    return np.concatenate([np.zeros(0), *(np.einsum("nd,nd->n", left[i[m : m + per]], right[j[m : m + per]]) for m in range(0, len(i), per))])

                yield {"block": [block], "grp": [row["grp"].as_py()]} | {c: [v] for c, v in work_on(row, row["parts"].values, score).items()}

    return map_arrow(pairs, work, f"block int, grp int, {schema}")


def _entries(parts: pa.StructArray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, place of the entry as query * ``size`` + vector, share) of each part."""
    for p in parts:
        if len(p["i"].values):
            yield p["part"].as_py(), column(p, "i").astype(np.int64) * size + column(p, "j"), column(p, "share")


def _table(i: np.ndarray, values: np.ndarray, n: int, k: int, empty: float) -> np.ndarray:
    """``values`` of the rows ``i`` (in order, at most ``k`` of each) as ``n`` rows of ``k``, filled up with ``empty``."""
    out = np.full((n, k), empty, values.dtype)
    out[i, np.arange(len(i)) - np.searchsorted(i, i)] = values
    return out.ravel()


def _by_group(tables: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(rows of one block of queries)``: what all blocks of vectors gave, as columns of arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return tables.groupBy("grp").applyInArrow(lambda t: pa.table([pa.array(c, f.type) for c, f in zip(work(t), arrow, strict=True)], schema=arrow), schema)


def _stacked(t: pa.Table, name: str) -> np.ndarray:
    """The arrays of a column, which are of one length, as rows."""
    return t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _first(at: np.ndarray, wide: int, score: Callable, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each query's ``k`` best entries; of equal scores the first, which have the smaller ids."""
    i, j = at // wide, at % wide
    scores = score(i, j)
    order = np.lexsort((j, -scores, i))
    order = order[first_of(i[order], k)]
    return i[order], j[order], scores[order]


def _kth(group: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k``-th members of groups that lie together."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return first[np.diff(first, append=len(group)) >= k] + k - 1


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = K, parts: int = PARTS) -> DataFrame:
    """The ``k`` highest integer inner products of every query with all vectors but its own row.

    Both tables have ``vec_id`` and ``embedding``.  Returns ``query_id, rank``
    (from 1), ``vec_id, score``; ties go to the smaller id; fewer rows if there
    are fewer vectors, none if there are none.  Rows without an id and vectors
    null or with a null or non-finite component take no part.  Repeated rows
    are rows of their own: a query's own row is one of the vectors that equal
    it in id and components (none, if the table does not hold it), its copies
    are met.  Vectors may differ in length: missing components count 0, so an
    empty vector scores 0 with all.  Squared lengths of scaled vectors must
    stay below 2 ** 53, else a ValueError is raised.  Other columns are not
    read, so their names cannot clash.
    """
    vectors, asked = integer_vectors(embeddings), integer_vectors(queries).withColumnsRenamed({"row": "q", "id": "query_id"})
    (n, size), (n_asked, longest) = _measure(vectors), _measure(asked)
    own = vectors.select(F.col("id").alias("query_id"), "copy", "v", F.col("row").alias("own"))
    asked = cut(asked.hint("merge").join(own, ["query_id", "copy", "v"], "left").withColumn("own", F.coalesce("own", F.lit(-1).cast("long"))), "queries")
    dims = [(int(d[0]) if len(d) else 0, len(d)) for d in np.array_split(np.arange(max(size, longest)), parts)]
    size = max(size, longest)
    # Blocks grow with the tables, so that the copies of the queries stay small beside the vectors.
    per, per_group = (min(max(least, n // 64), most) for least, n, most in ((VECTOR_BLOCK, n, MOST_VECTORS), (QUERY_BLOCK, n_asked, MOST_QUERIES)))
    n_blocks = max(1, -(-n // per))
    blocks = cut(packed(vectors.select("row", "id", "v"), "block", per, n, tuple(dims)), "vector-columns")
    groups = cut(packed(asked.select(F.col("q").alias("row"), F.col("query_id").alias("id"), "own", "v"), "grp", per_group, n_asked, tuple(dims)).withColumnRenamed("x", "a"), "query-columns")
    whole, whole_groups = blocks.where("part = -1").drop("part"), groups.where("part = -1").drop("part")

    def columns(asked: DataFrame) -> DataFrame:
        """Every block of queries beside every block of vectors, part by part; the queries, the smaller side, are repeated."""
        sent = asked.where("part >= 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        return beside(blocks.where("part >= 0"), n_blocks * parts, sent, "part")

    def looked_up(found: DataFrame, asked: DataFrame, *more: str) -> DataFrame:
        """The entries of all parts beside the whole vectors and queries of their blocks."""
        named = found.where(F.size("i") > 0).groupBy("block", "grp").agg(F.collect_list(F.struct("part", "i", "j", "share", *more)).alias("parts"))  # one for each part
        return beside(whole, n_blocks, named.join(asked.hint("merge"), "grp"))

    def local(row: dict, part: int, first: int, end: int, shares: np.ndarray) -> dict:
        i, j = highest(shares, k)
        low = np.where(shares > -np.inf, shares, np.inf).min(axis=1, initial=np.inf)
        return {"i": (i + first).astype(np.int32), "j": j.astype(np.int32), "share": shares[i, j], "low": low, "high": shares.max(axis=1, initial=-np.inf)}

    lists = cut(_met(columns(groups), dims, local, "i array<int>, j array<int>, share array<double>, low array<double>, high array<double>"), "local-lists")

    def scored(row: dict, found: pa.StructArray, score: Callable) -> dict:
        n_rows, wide = len(column(row["a"], "row")), len(column(row["x"], "row"))
        at = np.unique(np.concatenate([np.zeros(0, np.int64), *(place for _, place, _ in _entries(found, wide))]))
        ends = {"lows": np.full((parts, n_rows), np.inf), "highs": np.full((parts, n_rows), -np.inf)}
        for p in found:
            ends["lows"][p["part"].as_py()], ends["highs"][p["part"].as_py()] = column(p, "low"), column(p, "high")
        i, _, scores = _first(at, wide, score, k)
        return {"best": _table(i, scores, n_rows, k, -np.inf)} | {c: v.ravel() for c, v in ends.items()}

    seen = _whole(looked_up(lists, whole_groups, "low", "high"), size, scored, "best array<double>, lows array<double>, highs array<double>")

    def cutoffs(t: pa.Table) -> list:
        best, low, high = _stacked(t, "best"), _stacked(t, "lows").min(axis=0), _stacked(t, "highs").max(axis=0)
        best = -np.sort(-best.reshape(len(best), -1, k).transpose(1, 0, 2).reshape(-1, len(best) * k), axis=1)
        bound, low, high = best[:, k - 1], low.reshape(parts, -1), high.reshape(parts, -1)
        with np.errstate(invalid="ignore"):  # with fewer than k vectors there is no bound, and all entries are sent
            room, above = np.maximum(high - low, 1.0), np.maximum(bound - low.sum(axis=0), 0.0)
            # The last term is for rounding.
            cutoff = low + above * room / room.sum(axis=0) - 1e-6 - 1e-14 * (np.abs(low).sum(axis=0) + np.abs(bound))
        cutoff = np.where(bound > -np.inf, cutoff, -np.inf)
        return [[t["grp"][0].as_py()], [bound], [low.ravel()], [cutoff.ravel()]]

    limits = cut(_by_group(seen, cutoffs, "grp int, bound array<double>, low array<double>, cutoff array<double>"), "cutoffs")

    def enough(row: dict, part: int, first: int, end: int, shares: np.ndarray) -> dict:
        cutoff = row["cutoff"].values.to_numpy().reshape(parts, -1)[part, first:end, None]
        i, j = np.nonzero((shares >= cutoff) & (shares > -np.inf))
        return {"i": (i + first).astype(np.int32), "j": j.astype(np.int32), "share": shares[i, j].astype(np.float32)}

    found = cut(_met(columns(groups.join(limits.select("grp", "cutoff").hint("merge"), "grp")), dims, enough, "i array<int>, j array<int>, share array<float>"), "entries")

    def resolved(row: dict, found: pa.StructArray, score: Callable) -> dict:
        n_rows, wide, ids = len(column(row["a"], "row")), len(column(row["x"], "row")), column(row["x"], "id")
        bound = row["bound"].values.to_numpy()
        low, cutoff = (row[c].values.to_numpy().reshape(parts, -1) for c in ("low", "cutoff"))
        sent = list(_entries(found, wide))
        at = np.unique(np.concatenate([np.zeros(0, np.int64), *(place for _, place, _ in sent)]))
        i = at // wide
        lower, upper = np.zeros(len(at)), np.zeros(len(at))
        for p in range(parts):  # what a part has not sent lies between its lowest share and its cutoff
            from_low, to_high = low[p, i], cutoff[p, i]
            for _, place, share in (x for x in sent if x[0] == p):
                m, share = np.searchsorted(at, place), share.astype(np.float64)
                from_low[m], to_high[m] = share - np.abs(share) * ROUNDED, share + np.abs(share) * ROUNDED
            lower, upper = lower + from_low, upper + to_high
        order = np.lexsort((-lower, i))
        kth = order[_kth(i[order], k)]
        least = bound.copy()
        least[i[kth]] = np.maximum(least[i[kth]], lower[kth])
        i, j, scores = _first(at[upper >= least[i] - 1e-6 - 1e-14 * np.abs(least[i])], wide, score, k)
        return {"best": _table(i, scores, n_rows, k, -np.inf), "ids": _table(i, ids[j], n_rows, k, 0), "query_ids": column(row["a"], "id")}

    ends = _whole(looked_up(found, whole_groups.join(limits.hint("merge"), "grp")), size, resolved, "best array<double>, ids array<bigint>, query_ids array<bigint>")

    def merged(t: pa.Table) -> list:
        best, ids = (_stacked(t, c).reshape(t.num_rows, -1, k).transpose(1, 0, 2).reshape(-1, t.num_rows * k) for c in ("best", "ids"))
        order = np.lexsort((ids, -best))[:, :k]
        best, ids = np.take_along_axis(best, order, axis=1), np.take_along_axis(ids, order, axis=1)
        i, rank = np.nonzero(best > -np.inf)
        return [_stacked(t, "query_ids")[0][i], rank + 1, ids[i, rank], best[i, rank].astype(np.int64)]

    return _by_group(ends, merged, "query_id bigint, rank int, vec_id bigint, score bigint")
