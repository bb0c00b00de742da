"""Run a query on Spark and its SQL twin on DuckDB, and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET memory_limit = '8GB'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(_value(x)) for x in v) + "]"
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(_value(r[k]) for k in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """Returns (equal, report)."""
    start = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no twin, {took:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    duck = time.time() - start
    gc, gr = _rows(df.columns, got)
    wc, wr = _rows(names, want)
    if gc != wc:
        return False, f"columns {gc} != {wc}"
    if gr != wr:
        only_g = sorted(set(gr) - set(wr))[:3]
        only_w = sorted(set(wr) - set(gr))[:3]
        return False, f"{gc}: {len(gr)} vs {len(wr)} rows; spark only {only_g}; twin only {only_w}"
    return True, f"{len(gr)} rows, spark {took:.1f}s, twin {duck:.1f}s"


def main(argv):
    from cobasket import build_session
    from cobasket.plans import catalogue

    sf_dir = f"/root/testdata/sf{argv[0]}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    names = argv[1:] or list(catalogue.QUERIES)
    bad = 0
    for name in names:
        try:
            ok, report = compare(spark, con, catalogue.QUERIES[name], catalogue.TWINS.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001 - a report of all failures is wanted
            ok, report = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not ok
        print(("ok  " if ok else "FAIL"), name, report, flush=True)
    print(f"{len(names) - bad}/{len(names)} equal")


if __name__ == "__main__":
    main(sys.argv[1:])
