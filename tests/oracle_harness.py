"""Run registered queries on Spark and their SQL oracles on DuckDB; compare.

Comparison as the driver does it: column names sorted, row count, and an
order-insensitive multiset of rows (floats compared exactly, by their text).

    python tests/oracle_harness.py [--sf DIR] [name-prefix ...]
"""
from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        # exact: the text of the double, so -0.0 and last-bit differences show
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def duck(sql: str, sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    return cols, types, cur.fetchall()


def compare(spark, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = df.collect()
    scols = df.columns
    st = time.time() - t0
    if sql is None:
        return dict(name=name, ok=None, rows=len(srows), sec=round(st, 2), note="no oracle")
    dcols, dtypes, drows = duck(sql, sf_dir)
    sc, sr = canon(scols, srows)
    dc, dr = canon(dcols, drows)
    res = dict(name=name, rows=len(srows), oracle_rows=len(drows), sec=round(st, 2))
    if sc != dc:
        res.update(ok=False, note=f"columns differ: spark={sc} duck={dc}")
    elif sr != dr:
        diff_s = [r for r in sr if r not in set(dr)][:3]
        diff_d = [r for r in dr if r not in set(sr)][:3]
        res.update(ok=False, note=f"values differ: spark-only={diff_s} duck-only={diff_d}")
    else:
        res.update(ok=True)
    stypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    m = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE"}
    tmis = [f"{c}:{stypes[c]}/{t}" for c, t in zip(dcols, dtypes)
            if c in stypes and m.get(stypes[c], stypes[c]) != t and not (stypes[c] == "timestamp" and t.startswith("TIMESTAMP"))]
    if tmis:
        res["types"] = tmis
    return res


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    from scholargraph.plans import catalog
    from scholargraph.session import get_session

    spark = get_session("local[8]", partitions=8)
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    for name, fn in sorted(catalog.QUERIES.items()):
        if a.names and not any(name.startswith(p) for p in a.names):
            continue
        try:
            r = compare(spark, name, fn, catalog.ORACLE.get(name), a.sf)
        except Exception as e:  # report and go on
            r = dict(name=name, ok=False, note=f"error: {type(e).__name__}: {str(e)[:400]}")
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
