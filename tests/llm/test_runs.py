"""Periodic runs against a brute-force search, and the planted texts of the query against a plain rewrite."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import pytest
from pyspark.sql import functions as F

from wardlens.llm import queries, runs

DOCS = "doc_id bigint, text string, runs string, start string, collapsed int, length int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """Every stretch of equal words q apart, for each q; the smallest q stands for a stretch."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            a = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - a >= max(least, 2 * q):
                found.setdefault((a, i + q), q)
            i += 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def rest(words, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        few, size = rng.choice((1, 2, 2, 3, 5, 30)), rng.choice((1, 11, 12, 13, 40, 90, 200))
        w = [f"w{rng.randrange(few)}" for _ in range(size)]
        if rng.random() < 0.6:  # periodic from some place on
            a, p = rng.randrange(size), rng.randint(1, size // 2 + 1)
            w = [w[i] if i < a else w[a + (i - a) % min(p, size - a)] for i in range(size)]
        if rng.random() < 0.3:  # a square, and another one that overlaps it
            u = w[: rng.randint(1, size)]
            w = w[:5] + u + u + w[3:9] + u + u[:-1]
        yield w


@pytest.mark.parametrize("seed", range(4))
def test_find_runs_brute_force(seed):
    lists = list(texts(seed, 300)) + [[]]
    got = {}
    for t, *r in zip(*runs.find_runs([[w.encode() for w in x] for x in lists]), strict=True):
        got.setdefault(int(t), []).append(tuple(map(int, r)))
    assert [got.get(i, []) for i in range(len(lists))] == [brute(x) for x in lists]


def test_operator(spark):
    rows = [(i, "\n\t ".join(w)) for i, w in enumerate(texts(9, 80))]
    rows += [(None, "a " * 30), (900, None), (901, ""), (902, " \n "), (903, "x y " * 20), (903, "x y " * 20), (904, "Ab ab " * 12), (905, "é 漢 " * 9 + "end")]
    table = spark.createDataFrame([(*r, "r", "s", 1, 2) for r in rows], DOCS)
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(table).collect()), key=repr)
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    assert got == sorted(((i, f := brute(w), rest(w, f)) for i, w in words), key=repr)
    assert runs.periodic_runs(table.where("false")).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(table, least=9)


def test_long_texts_take_time_in_proportion():
    took = []
    for n in (50_000, 200_000):
        start = time.perf_counter()
        found = runs.find_runs([[b"x"] * n, [b"a", b"b", b"a"] * (n // 3)])
        took.append(time.perf_counter() - start)
        assert [x.tolist() for x in found] == [[0, 1], [0, 0], [n, n // 3 * 3], [1, 3]]
    assert took[1] < 12 * took[0] + 1


def test_query_brute_force(spark, tmp_path):
    """The query over planted documents, by a plain rewrite of its definition."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("alpha", "beta", "gamma", "Delta")) + str(rng.randrange(40)) for _ in range(rng.choice((0, 1, 5, 30, 120, 400))))) for i in range(300)]
    rows += [(5000, None), (None, "x " * 20), (5002, "one line\nand " * 8)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected, planted = [], 0
    for i, t in rows:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a, planted = g % n, planted + 1
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        found = brute(w)
        s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected.append((i, len(found), s, n, q, 1000 * n // q if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)), sha(rest(w, found))))
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if c[-6:] != "sha256"} == {"bigint"}
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected)) and planted > 20


def test_planted_is_native(spark):
    table = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    plan = table.select(runs.planted(F.col("text"), F.col("doc_id")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
