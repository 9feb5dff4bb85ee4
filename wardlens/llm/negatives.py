"""Hard negatives by disjoint slots of scores.

An anchor's positives are the rows of its label with the highest scores.  Each
positive asks for the best rows of other labels in a window of scores below its
own.  The windows overlap, so they are not searched one by one: their upper
limits, in descending order, cut the scores into disjoint slots.  A row of
another label falls into one slot of an anchor, and combiners keep a slot's k
best rows, first of each block of rows, then of all.  A window's rows lie in
its own slot and those below, so the k best of its slots' lists, merged from
its own slot down, and cut at its lower limit, are its answer.

Rows and anchors are held in blocks of bounded size, as packed arrays.  The
anchors, the smaller side, are sent to every block of rows, never by the driver.  Scores are computed block by block and
never leave the task, but for the k best of a slot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlens.llm.common import cut, map_arrow

POSITIVES, NEGATIVES = 5, 3
#: Windows: LOW * positive <= 100 * negative <= HIGH * positive.
LOW, HIGH = 50, 95
SCALE = 256
ANCHOR_BLOCK, ROW_BLOCK = 1024, 8192
#: Blocks of a large table have more rows, up to these.
MOST_ANCHORS, MOST_ROWS = 4096, 16384
#: Anchors whose scores with one block are held at once, and scores.
STEP, SCORES = 128, 1 << 20
#: Scores and what is computed from them stay exact below this size of a score.
MOST = 1 << 40


def vector_rows(embeddings: DataFrame, scale: int, label: Column, is_anchor: Column) -> DataFrame:
    """``row, id, label, v, anchor`` of the rows that take part; ``row`` tells repeated rows apart."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).where(finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), label.cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"), is_anchor.alias("anchor"))
    return cut(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")


def exact(rows: DataFrame) -> int:
    """The longest vector's size; an error if scores could leave the range in which they are exact."""
    size, most = rows.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))).first()
    if (most or 0.0) >= MOST:  # a score is at most the product of two lengths
        raise ValueError(f"squared length {most} of a scaled vector: scores are exact below {MOST} only")
    return size or 0


def packed(rows: DataFrame, name: str, per: int, n: int, dims: tuple[tuple[int, int], ...] = ()) -> DataFrame:
    """Blocks of ``per`` rows on average, by a hash of the row: ``name`` (the number), ``part``, and ``x``, the columns as arrays, ordered by id.

    The vectors are 32-bit numbers laid end to end.  Part -1 has them whole,
    each part from 0 on the columns (first, number) that ``dims`` gives it.
    """
    count = max(1, -(-n // per))
    fields = [c for c in rows.columns if c != "v"]
    block = F.pmod(F.xxhash64("row"), F.lit(count)).cast("int").alias(name)
    dealt = rows.select(block, *rows.columns).repartition(min(count, 2000), name).sortWithinPartitions(name, "id", "row")
    arrays = ", ".join(f"{c}: array<{kind}>" for c, kind in rows.dtypes if c != "v")

    def filled(number: int, slices: list[pa.RecordBatch]) -> dict:
        t = pa.Table.from_batches(slices).combine_chunks()
        vectors = t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"]
        n = np.diff(vectors.offsets.to_numpy()).astype(np.int32)
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)
        shares = [(n, flat)] + [(np.clip(n - first, 0, size), flat[(place >= first) & (place < first + size)]) for first, size in dims]
        common = {c: t[c].to_numpy() for c in fields}
        x = [common | {"sizes": sizes.astype(np.int32), "v": v.tobytes()} for sizes, v in shares]
        return {name: [number] * len(x), "part": list(range(-1, len(dims))), "x": x}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, slices = None, []
        for b in batches:
            numbers = b.column(name).to_numpy()
            ends = [0, *np.flatnonzero(np.diff(numbers)) + 1, len(numbers)]
            for first, end in zip(ends, ends[1:], strict=False):
                if end > first:
                    if slices and numbers[first] != now:
                        yield filled(now, slices)
                        slices = []
                    now = int(numbers[first])
                    slices.append(b.slice(first, end - first))
        if slices:
            yield filled(now, slices)

    return map_arrow(dealt, work, f"{name} int, part int, x struct<{arrays}, sizes: array<int>, v: binary>")


def column(x: pa.StructScalar, name: str) -> np.ndarray:
    return x[name].values.to_numpy(zero_copy_only=False)


def matrix(x: pa.StructScalar, size: int) -> np.ndarray:
    """The vectors of a block as rows of a matrix, missing components 0."""
    n = column(x, "sizes")
    out = np.zeros((len(n), size))
    v = np.frombuffer(x["v"].as_buffer(), np.int32)
    if len(v) == out.size:
        out[:] = v.reshape(out.shape)
    else:
        out[np.repeat(np.arange(len(n)), n), np.arange(len(v)) - np.repeat(np.cumsum(n, dtype=np.int64) - n, n)] = v
    return out


def best(scores: np.ndarray, slots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) places of the ``k`` highest scores of each anchor and slot (0: none); of equal scores, the first rows."""
    i, j = np.nonzero(slots)
    order = np.lexsort((-scores[i, j], slots[i, j], i))  # stable: equal scores stay in the order of their rows
    i, j = i[order], j[order]
    group = i * (np.int64(slots.max(initial=0)) + 1) + slots[i, j]
    top = first_of(group, k)
    return i[top], j[top]


def first_of(group: np.ndarray, k: int) -> np.ndarray:
    """Which are among the first ``k`` of their group; groups lie together."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return np.arange(len(group)) - np.repeat(first, np.diff(first, append=len(group))) < k


#: Columns of which :func:`highest` first takes the maximum.
STRIDE = 64


def highest(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) places of each row's ``k`` highest scores, from the highest; -inf: none; of equal scores, the first columns."""
    most, wide = scores.max(axis=1, initial=-np.inf, keepdims=True), scores.shape[1] // STRIDE
    if wide >= k:  # the k-th highest maximum of a stretch: k scores at least reach it
        stretch = scores[:, : wide * STRIDE].reshape(len(scores), wide, STRIDE).max(axis=2)
        least = np.partition(stretch, wide - k, axis=1)[:, wide - k, None]
    else:
        least = np.full_like(most, -np.inf)
    i, j = np.nonzero((scores >= least) & (scores > -np.inf))
    order = np.lexsort((j, -scores[i, j], i))
    i, j = i[order], j[order]
    top = first_of(i, k)
    return i[top], j[top]


def beside(blocks: DataFrame, n: int, asked: DataFrame, *keys: str) -> DataFrame:
    """``blocks`` joined with ``asked`` on the block's number (and ``keys``), ``n`` blocks in all.

    Always by sorting: a side can be small in files and far larger in memory, so it must never be collected for a broadcast.
    """
    return blocks.repartition(max(1, min(n, 2000)), "block", *keys).join(asked.hint("merge"), ["block", *keys])


def meet(pairs: DataFrame, size: int, pick: Callable, schema: str) -> DataFrame:
    """``pick(anchors, first, end, rows, scores)`` over the pairs of blocks, for the anchors from ``first`` to ``end``; scores are integers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, right = None, None
        for b in batches:
            for i, block in enumerate(b.column("block").to_pylist()):
                a, x = b.column("a")[i], b.column("x")[i]
                if block != now:
                    now, right = block, matrix(x, size).T
                left = matrix(a, size)
                step = max(1, min(STEP, SCORES // max(1, right.shape[1])))
                for j in range(0, len(left), step):
                    yield pick(a, j, j + step, x, left[j : j + step] @ right)

    return map_arrow(pairs.select("block", "a", "x"), work, schema)


def hard_negatives(
    embeddings: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """The hard negatives of every anchor and positive.

    ``embeddings`` has ``vec_id, embedding, label``; ``is_anchor`` and
    ``label`` (instead of the table's) are expressions over it.  Components
    become ``floor(scale * x)``; a score is an integer inner product, missing
    components of shorter vectors count 0.  An anchor's positives are its
    ``positives`` best other rows of the same label.  For each, the
    ``negatives`` best rows of another label with ``low * positive <= 100 *
    negative <= high * positive`` (scores) are returned: ``anchor_id,
    positive_id, rank`` (from 1), ``negative_id, positive_score,
    negative_score``.  Ties go to the smaller id; an anchor without positives,
    or a window without rows, gives none; so does a window of a score below 0,
    which is empty.

    Rows with a null id, label or vector, or a null or non-finite component,
    take no part; an empty vector scores 0.  Repeated rows are rows of their
    own: each is an anchor, and meets its copies.  Scaled vectors must stay
    below a squared length of ``MOST``, else a ValueError is raised.  Other
    columns are not read, so their names cannot clash.
    """
    rows = vector_rows(embeddings, scale, F.col("label") if label is None else label, is_anchor)
    size, n = exact(rows), rows.count()
    anchors = rows.where("anchor")
    n_anchors = anchors.count()
    # Blocks grow with the tables, so that the copies of the anchors stay small beside the rows.
    per, per_part = (min(max(least, n // 64), most) for least, n, most in ((ROW_BLOCK, n, MOST_ROWS), (ANCHOR_BLOCK, n_anchors, MOST_ANCHORS)))
    n_blocks = max(1, -(-n // per))
    of_rows = cut(packed(rows.drop("anchor"), "block", per, n), "negatives-blocks")

    def with_rows(asked: DataFrame) -> DataFrame:
        """Every block of anchors beside every block of rows; the anchors, the smaller side, are repeated."""
        sent = packed(asked, "group", per_part, n_anchors).select("group", F.col("x").alias("a"))
        sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        return beside(of_rows.select("block", "x"), n_blocks, sent)

    def nearest(a: pa.StructScalar, first: int, end: int, x: pa.StructScalar, scores: np.ndarray) -> dict:
        own = column(a, "row")[first:end]
        scores[(column(a, "label")[first:end, None] != column(x, "label")) | (own[:, None] == column(x, "row"))] = -np.inf
        i, j = highest(scores, positives)
        return {"anchor": own[i], "row": column(x, "row")[j], "id": column(x, "id")[j], "score": scores[i, j].astype(np.int64)}

    found = meet(with_rows(anchors.drop("anchor")), size, nearest, "anchor bigint, row bigint, id bigint, score bigint")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    chosen = found.withColumn("slot", F.row_number().over(first)).where((F.col("slot") <= positives) & (F.col("score") >= 0))
    top = F.expr(f"({high} * score) div 100").alias("top")
    least = F.expr(f"({low} * score + 99) div 100").alias("least")
    chosen = cut(chosen.select("anchor", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), top, least), "negatives-positives")

    windows = chosen.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "top"))).alias("w"), F.min("least").alias("least"))  # at most `positives`
    none = F.lit(np.iinfo(np.int64).min)
    tops = [F.coalesce(F.get("w.top", F.lit(m)), none).alias(f"top{m}") for m in range(positives)]
    asked = anchors.drop("anchor").join(windows.select(F.col("anchor").alias("row"), *tops, "least").hint("merge"), "row")

    def in_slots(a: pa.StructScalar, first: int, end: int, x: pa.StructScalar, scores: np.ndarray) -> dict:
        slots = np.zeros(scores.shape, np.int8)
        for m in range(positives):
            slots += scores <= column(a, f"top{m}")[first:end, None]  # how many upper limits a score stays under
        slots[(column(a, "label")[first:end, None] == column(x, "label")) | (scores < column(a, "least")[first:end, None])] = 0
        i, j = best(scores, slots, negatives)
        return {"anchor": column(a, "row")[first:end][i], "slot": slots[i, j], "id": column(x, "id")[j], "score": scores[i, j].astype(np.int64)}

    entries = meet(with_rows(asked), size, in_slots, "anchor bigint, slot int, id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    entries = entries.withColumn("place", place).where(F.col("place") <= negatives)
    listed = entries.groupBy("anchor").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "slot")).alias("e"))  # at most positives * negatives
    # The best of a window's own slot and all below it; slots are numbered from the highest.
    merged = F.slice(F.array_sort(F.filter("e", lambda e: e["slot"] >= F.col("slot"))), 1, negatives)
    inside = F.filter(merged, lambda e: -e["s"] >= F.col("least"))
    out = chosen.join(listed, "anchor").select("*", F.posexplode(inside).alias("i", "n")).join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", (F.col("i") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.s")).alias("negative_score"))
