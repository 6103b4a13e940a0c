"""Run registered queries in Spark and their SQL oracles in DuckDB; compare results.

Usage: python tools/check_oracle.py [SF_DIR] [name ...]
Compares row count, column names (sorted) and an order-insensitive multiset of
rows with doubles rounded to 6 decimals.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from ragtide.plans.registry import load_all  # noqa: E402
from ragtide.session import get_session  # noqa: E402
from ragtide.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return str(v)


_TYPES = {T.LongType: "BIGINT", T.DoubleType: "DOUBLE", T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN"}


def _type_mismatches(schema, description):
    duck = {d[0]: str(d[1]) for d in description}
    out = []
    for f in schema.fields:
        st = _TYPES.get(type(f.dataType), f.dataType.simpleString())
        if duck.get(f.name) != st:
            out.append(f"{f.name}: spark {st} / duckdb {duck.get(f.name)}")
    return out


def _rows(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in records)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    reg = load_all()
    spark = get_session()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    ok = bad = 0
    for name, q in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = q.fn(spark, sf)
            schema = df.schema
            scols = df.columns
            srec = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.sql is None:
            print(f"ROWS  {name}: {len(srec)} rows ({ts:.1f}s) [no oracle]")
            ok += 1
            continue
        try:
            cur = con.execute(q.sql)
            dcols = [c[0] for c in cur.description]
            drec = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL  {name}: columns spark={sorted(scols)} duckdb={sorted(dcols)}")
            bad += 1
            continue
        a, b = _rows(scols, srec), _rows(dcols, drec)
        types = _type_mismatches(schema, cur.description)
        if a == b and types:
            print(f"FAIL  {name}: values equal but types differ: {types}")
            bad += 1
        elif a == b:
            print(f"OK    {name}: {len(a)} rows ({ts:.1f}s)")
            ok += 1
        else:
            sa, sb = set(a), set(b)
            print(f"FAIL  {name}: spark {len(a)} rows, duckdb {len(b)} rows; cols {sorted(scols)}")
            print("      only spark :", sorted(sa - sb)[:3])
            print("      only duckdb:", sorted(sb - sa)[:3])
            bad += 1
    print(f"== {ok} ok, {bad} failed")


if __name__ == "__main__":
    main()
