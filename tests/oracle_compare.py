"""Run registered queries in Spark and their SQL in DuckDB, and compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


SPARK_TO_DUCK = {"LongType()": "BIGINT", "IntegerType()": "INTEGER", "DoubleType()": "DOUBLE",
                 "StringType()": "VARCHAR", "BooleanType()": "BOOLEAN", "FloatType()": "FLOAT",
                 "TimestampNTZType()": "TIMESTAMP"}


def type_mismatches(df, con, sql):
    st = {f.name: SPARK_TO_DUCK.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields}
    rel = con.sql(sql)
    dt = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_duck(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    data = rel.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, sorted((tuple(_norm(r[i]) for i in idx) for r in data), key=repr)


def compare(spark, sf_dir: str, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            sc, sr = rows_of_spark(sdf)
        except Exception as e:  # noqa: BLE001
            results[name] = f"spark error: {type(e).__name__}: {str(e)[:300]}"
            print(name, results[name]) if verbose else None
            continue
        t1 = time.time()
        if name not in sqls:
            results[name] = f"no-oracle rows={len(sr)}"
        else:
            try:
                dc, dr = rows_of_duck(con, sqls[name])
            except Exception as e:  # noqa: BLE001
                results[name] = f"duck error: {str(e)[:300]}"
                print(name, results[name]) if verbose else None
                continue
            tm = type_mismatches(sdf, con, sqls[name])
            if sc != dc:
                results[name] = f"column mismatch spark={sc} duck={dc}"
            elif tm:
                results[name] = f"type mismatch {tm}"
            elif sr != dr:
                diff = [r for r in sr if r not in set(dr)][:3]
                diff2 = [r for r in dr if r not in set(sr)][:3]
                results[name] = f"value mismatch rows spark={len(sr)} duck={len(dr)} s-only={diff} d-only={diff2}"
            else:
                results[name] = f"ok rows={len(sr)}"
        if verbose:
            print(f"{name}: {results[name]}  [{t1 - t0:.1f}s spark, {time.time() - t1:.1f}s duck]", flush=True)
    return results


if __name__ == "__main__":
    from papyra.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = {k: v for k, v in res.items() if not v.startswith(("ok", "no-oracle"))}
    print(f"{len(res) - len(bad)}/{len(res)} ok")
    for k, v in bad.items():
        print("FAIL", k, v[:500])
