"""Run every query beside its SQL and compare the values exactly.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from tablefacts.session import configure

from .oracles import ORACLES
from .queries import QUERIES, TABLES


def plain_value(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def sorted_rows(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(plain_value(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(picked, key=lambda r: [(v is None, str(type(v)), str(v)) for v in r])


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> str:
    """Empty if the results agree, else what differs."""
    frame = QUERIES[name](spark, sf_dir)
    ours = sorted_rows(frame.columns, frame.collect())
    if name not in ORACLES:
        return "" if ours[1] else "no rows"
    result = con.execute(ORACLES[name])
    theirs = sorted_rows([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} / {len(theirs[1])}: {ours[1][:2]} / {theirs[1][:2]}"
    different = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    if different:
        return f"{len(different)} rows differ, first {different[0][0]}\n   / {different[0][1]}"
    types = [(a, type(x).__name__, type(y).__name__) for a, x, y in zip(ours[0], *(r[0] for r in (ours[1], theirs[1])))] if ours[1] else []
    wrong = [t for t in types if t[1] != t[2] and "NoneType" not in t]
    return f"types {wrong}" if wrong else ""


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = configure(builder.config("spark.driver.memory", "8g")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        kind = "sql" if name in ORACLES else "rows only"
        print(f"{'FAIL' if problem else 'ok':4} {time.time() - start:6.2f}s {name} ({kind}) {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
