"""Hard negatives against brute force: ties, repeated rows, odd vectors, overlapping and empty windows, several blocks."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardlens.llm import negatives

VECTORS = "vec_id bigint, embedding array<float>, label int, row string, id string, score int, block int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "r", "i", 1, 2) for r in rows], VECTORS)


def brute(rows, positives=5, k=3, scale=256):
    good = []
    for r, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((r, i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(scale * x) for x in v]))
    out = Counter()
    for r, i, label, v in good:
        if i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m == label) for s, j, m, w in good if s != r]
        for ps, p, _ in sorted(x for x in scored if x[2])[:positives]:
            window = sorted(x for x in scored if not x[2] and 50 * -ps <= 100 * -x[0] <= 95 * -ps)
            out.update((i, p, n, j, -ps, -ns) for n, (ns, j, _) in enumerate(window[:k], 1))
    return out


def found(df):
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in got.collect())


@pytest.mark.parametrize("blocks", [(1024, 8192, 128), (3, 20, 2)])
def test_brute_force(spark, monkeypatch, blocks):
    for name, n in zip(("ANCHOR_BLOCK", "ROW_BLOCK", "STEP"), blocks, strict=True):
        monkeypatch.setattr(negatives, name, n)
    rng = random.Random(11)
    part = lambda: rng.choice((-0.5, 0.25, 0.5, 0.75))  # noqa: E731  # few values: many ties
    rows = [(i, [part() for _ in range(6)], rng.randrange(3)) for i in range(0, 400)]
    rows += [(10 * i, [rng.random() for _ in range(6)], rng.randrange(3)) for i in range(60)]  # ids that repeat
    rows += [rows[50], rows[50], rows[51], rows[100]] + [(1000 + i, [0.5] * 6, i % 2) for i in range(40)]  # copies and a common vector
    rows += [(None, [0.5] * 6, 1), (50, None, 1), (50, [0.5] * 6, None), (50, [0.5, None], 1), (50, [float("nan")], 1), (50, [float("inf")], 2)]
    rows += [(5000, [], 1), (5050, [0.5, 0.75], 1), (5100, [0.25] * 9, 0), (5150, [-0.5] * 6, 2), (5200, [0.0] * 6, 7)]
    expected = brute(rows)
    assert found(table(spark, rows)) == expected and len(expected) > 100


def test_edges(spark):
    assert not found(table(spark, []))
    assert not found(table(spark, [(50, [1.0], 1), (51, [0.5], 2)]))  # no positive
    assert not found(table(spark, [(50, [1.0], 1), (51, [-1.0], 1), (52, [-0.7], 2)]))  # an empty window below 0
    assert found(table(spark, [(50, [1.0], 1), (51, [1.0], 1), (52, [0.5], 2), (53, [0.9501], 2), (54, [0.95], 2)])) == Counter([(50, 51, 1, 53, 65536, 62208), (50, 51, 2, 54, 65536, 62208), (50, 51, 3, 52, 65536, 32768)])
    with pytest.raises(ValueError):
        found(table(spark, [(50, [1e30], 1)]))


def test_no_pair_of_rows_is_shuffled(spark):
    """Only the best rows of a slot leave a task: the plan holds no join of rows with rows."""
    rows = table(spark, [(i, [i / 100, 0.5], i % 3) for i in range(100)])
    got = negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_blocks_meet_without_broadcast(spark, monkeypatch):
    """Copies of the anchors are small in files and large in memory; the driver must not collect them."""
    plans, plain = [], negatives.map_arrow
    monkeypatch.setattr(negatives, "map_arrow", lambda df, *more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, *more))
    rows = table(spark, [(i, [i / 100, 0.5], i % 3) for i in range(100)])
    assert negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0).count() > 0
    assert sum("Join" in p for p in plans) >= 2 and not any("Broadcast" in p for p in plans)
