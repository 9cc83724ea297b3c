"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

    python -m checks.compare [--dir DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import tempfile
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from . import load_all
from .registry import REGISTRY, run
from .views import BASE


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("checks")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checks-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value):
    """A value both engines agree on."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return int(value) if value == int(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value if isinstance(value, (int, str)) else str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir: str):
    con = duckdb.connect()
    for b in BASE:
        con.sql(f"create view {b} as select * from '{sf_dir}/{b}.parquet'")
    return con


def compare(name: str, spark: SparkSession, con, sf_dir: str) -> tuple[bool, str]:
    df = run(name, spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    sql = REGISTRY[name].sql
    if sql is None:
        return True, f"{len(got)} rows, no SQL"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got == want:
        return len(got) > 0, f"{len(got)} rows"
    got_set, want_set = set(got), set(want)
    extra = [r for r in got if r not in want_set][:3]
    missing = [r for r in want if r not in got_set][:3]
    return False, f"{len(got)} rows against {len(want)}\n  {sorted(columns)}\n  spark: {extra}\n  sql:   {missing}"


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    load_all()
    spark, con = session(), connect(args.dir)
    bad = 0
    for name in REGISTRY:
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        start = time.time()
        try:
            ok, note = compare(name, spark, con, args.dir)
        except Exception as e:
            ok, note = False, "".join(traceback.format_exception_only(e))[:1500]
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
