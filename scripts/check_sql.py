"""Run registered queries next to their SQL and report rows, columns and values that differ.

    python scripts/check_sql.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import tempfile
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stratalens.plans.catalog import QUERIES, SQL  # noqa: E402
from stratalens.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES.split():
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def ordered(rows):
    return sorted((tuple(plain(v) for v in row) for row in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, name: str, sf_dir: str, allow_empty: bool = False) -> tuple[str, float]:
    start = time.time()
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = ordered(tuple(row[c] for c in columns) for row in frame.collect())
    took = time.time() - start
    if name not in SQL:
        return (f"rows only: {len(got)}" if got else "EMPTY"), took
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return f"COLUMNS differ: {columns} / {sorted(names)}", took
    order = [names.index(c) for c in columns]
    raw = result.fetchall()
    want = ordered(tuple(row[i] for i in order) for row in raw)
    if not got and not allow_empty:
        return "EMPTY", took
    if len(got) != len(want):
        return f"ROWS differ: {len(got)} / {len(want)}", took
    for a, b in zip(got, want):
        if a != b:
            return f"VALUES differ: {columns}\n   {a}\n   {b}", took
    types = {str(d[1]) for d in result.description}
    odd = types & {"HUGEINT", "DECIMAL"} | {t for t in types if t.startswith("DECIMAL")}
    return (f"ok, {len(got)} rows" + (f"  TYPES {odd}" if odd else "")), took


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_ui_showConsoleProgress="false", spark_driver_memory="8g", spark_checkpoint_dir=tempfile.mkdtemp(prefix="spark-check-"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name in QUERIES:
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        try:
            verdict, took = compare(spark, con, name, args.sf)
        except Exception as error:  # report every query, then fail
            verdict, took = f"FAILED {type(error).__name__}: {str(error)[:300]}", 0.0
        bad += not (verdict.startswith("ok") or verdict.startswith("rows only")) or "TYPES" in verdict
        print(f"{name:32s} {took:6.2f}s  {verdict}", flush=True)
    print(f"{bad} problem(s)")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
