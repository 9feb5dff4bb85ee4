"""What the top-k operator moves: blocks meet without a broadcast, entries stay few and lie in arrays."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from wardlens.llm import topk


def vectors(spark, n, size):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(i, [float(x) for x in rng.normal(size=size)]) for i in range(n)], "vec_id bigint, embedding array<double>")


def test_no_side_is_broadcast(spark, monkeypatch):
    """Copies of the queries are small in files and large in memory; the driver must not collect them."""
    plans, plain = [], topk.map_arrow
    monkeypatch.setattr(topk, "map_arrow", lambda df, *more: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df, *more))
    t = vectors(spark, 40, 3)
    assert topk.top_k(t, t.where("vec_id < 2"), k=3).count() == 6
    assert sum("Join" in p for p in plans) >= 2 and not any("Broadcast" in p for p in plans)


def test_entries_are_few(spark, monkeypatch):
    """The bound is near the k-th score, so few vectors reach a cutoff; the vectors' own tables aside, rows grow with pairs of blocks only."""
    rows, entries, plain = Counter(), Counter(), topk.cut

    def counted(df, name):
        out = plain(df, name)
        rows[name] += out.count()
        if "i" in out.columns:
            entries[name] += out.agg(F.sum(F.size("i"))).first()[0]
        return out

    monkeypatch.setattr(topk, "cut", counted)
    t = vectors(spark, 1500, 32)
    assert topk.top_k(t, t.where("vec_id % 100 = 0")).count() == 150
    assert sum(n for name, n in rows.items() if name not in ("vectors", "queries")) < 20
    assert entries["entries"] < 0.2 * 15 * 1500
