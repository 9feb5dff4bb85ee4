"""Registered queries against their SQL, and the pipeline against its operators, on sf0.001."""

from __future__ import annotations

import random

import duckdb
import pytest

from tests.llm.test_operators import TOKENS, brute_components, low
from wardlens.llm import line_dedup, queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    got = con.execute(queries.ORACLE[name])
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == sorted(df.columns)
    expected = sorted(repr(tuple(r[i] for i in order)) for r in got.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(sorted(names)).collect()) == expected


def test_pipeline(spark):
    import corpus_pipeline

    given = spark.read.parquet(f"{SF}/documents.parquet")
    docs, sizes = given, [given.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = queries.minhash.cut(stage(spark, docs, SF), "test")
        assert docs.columns == given.columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_brute_force(spark, tmp_path):
    """``run`` over planted copies, short lines, toxic rows in four languages and benchmark passages, by document."""
    import corpus_pipeline

    rng = random.Random(77)
    clean = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(clean) for _ in range(n))
    passages = [line(40) for _ in range(6)]
    insults = {"en": ("grumflop", 340), "de": ("achlichpfau", 120), "fr": ("réeuxvimont", 120), "es": ("bomenteco", 120)}
    rows, toxic = {}, {}
    for insult, n in insults.values():
        for k in range(n):
            i = len(rows)
            toxic[i] = int(k % 4 == 0)
            first = line(30).split()
            first[7:7] = [insult] * toxic[i]
            rows[i] = "\n".join([" ".join(first), line(rng.randint(1, 4)), line(25)])
    for i, p in enumerate(passages):
        rows[800 + i] = f"{line(20)}\n{p}\n{line(10)}"
    good = [i for i, y in toxic.items() if not y]
    for i in good[:40]:
        rows[1000 + i] = rows[i]  # an exact copy with a short line
        rows[2000 + i] = rows[i].replace("\n", "\n\n")  # a copy with blank lines
        w = rows[i].split(" ")
        w[3] = "changed"
        rows[3000 + i] = " ".join(w)  # a near copy, whose first line is one
        w = rows[good[60 + i % 40]].replace("\n", " ").split(" ")
        w[5] = "changed"
        rows[4000 + i] = " ".join(w)  # a near copy as one line: only the near-duplicate stage sees it
    full = [(i, t, "en", "s", len(t)) for i, t in rows.items()]
    for name, data, schema in (("documents", full, "doc_id bigint, text string, lang string, source string, n_chars bigint"), ("labels", [(i, 1, y) for i, y in toxic.items()], "doc_id bigint, quality int, toxic int"), ("benchmark", list(enumerate(passages)), "item_id bigint, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    left = {i: t for i, t in sorted(rows.items()) if not toxic.get(i)}
    seen, kept = [], {}
    for i, t in left.items():
        stay = []
        for x in t.split("\n"):
            s = set(TOKENS.findall(low(x)))
            if not s or not any(100 * len(s & q) >= line_dedup.PERCENT * len(s | q) for q in seen):
                stay.append(x)
            if s:
                seen.append(s)
        if any(x.strip() for x in stay):
            kept[i] = "\n".join(stay)
    parts = brute_components(list(kept.items()), 5, 80)
    left = {i for i in kept if parts[i][1] == i}
    expected = {i for i in left if not any(p in kept[i] for p in passages)}
    assert {i for i in expected if i >= 1000} < set(kept) and len(expected) < len(left) < len(kept) < len(rows)
    assert not any(1000 <= i < 3000 for i in expected)
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()
    assert {r.doc_id for r in got} == expected
