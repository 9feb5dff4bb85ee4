"""Run a registered query in Spark and its oracle SQL in DuckDB; compare.

Comparison is order-insensitive, columns sorted by name, values exact
(decimals by value, floats by repr).  Usable from pytest and the CLI:

    python tests/oracle_harness.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        return ("D", str(v))  # exact text: scale differences count
    if isinstance(v, float):
        if math.isnan(v):
            return ("F", "nan")
        return ("F", repr(v))
    if isinstance(v, bool):
        return ("B", v)
    if isinstance(v, int):
        return ("I", v)
    if isinstance(v, dt.datetime):
        return ("T", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("T", v.isoformat())
    return ("S", str(v))


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)
    return [cols[i] for i in order], out


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def type_diffs(sdf, con, sql):
    rel = con.sql(sql)
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    out = []
    for f in sdf.schema.fields:
        t = f.dataType.simpleString()
        if duck_types.get(f.name) != SPARK_TO_DUCK.get(t, t.upper()):
            out.append((f.name, t, duck_types.get(f.name)))
    return out


def compare(spark, con, name, sf_dir, verbose=True):
    from __spark_entry__ import oracle_sql, queries
    q = queries()[name]
    sql = oracle_sql().get(name)
    t0 = time.time()
    sdf = q(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    if sql is None:
        return {"name": name, "rows": len(srows), "oracle": None, "spark_s": round(t1 - t0, 2)}
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    sc, sr = canon(scols, srows)
    oc, orr = canon(ocols, orows)
    ok_cols = sc == oc
    ok_rows = len(sr) == len(orr)
    ok_vals = sr == orr
    out = {"name": name, "rows": len(srows), "orows": len(orows), "cols": ok_cols, "vals": ok_vals,
           "types": type_diffs(sdf, con, sql), "spark_s": round(t1 - t0, 2)}
    if verbose and not (ok_cols and ok_rows and ok_vals):
        out["scols"], out["ocols"] = sc, oc
        diff_s = [r for r in sr if r not in set(orr)][:3]
        diff_o = [r for r in orr if r not in set(sr)][:3]
        out["only_spark"], out["only_oracle"] = diff_s, diff_o
    return out


if __name__ == "__main__":
    from wardlens.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]", 8)
    con = duck(sf)
    from __spark_entry__ import queries
    names = names or list(queries())
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf)
        except Exception as e:  # report and continue
            r = {"name": n, "error": repr(e)[:600]}
        good = r.get("oracle", 1) is None or (r.get("cols") and r.get("vals") and not r.get("types"))
        bad += 0 if good and "error" not in r else 1
        print(("OK  " if good and "error" not in r else "BAD ") + str(r), flush=True)
    print("failures:", bad)
