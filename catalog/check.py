"""Run registered queries against their DuckDB twins: ``python -m catalog.check [--sf DIR] [names]``."""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

from catalog.registry import oracle_sql, queries
from chronofold.sources.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    return repr(value)


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir: str, name: str) -> str:
    frame = queries()[name](spark, sf_dir)
    rows = [tuple(row) for row in frame.collect()]
    if name not in oracle_sql():
        return f"rows only ({len(rows)})"
    answer = connection.execute(oracle_sql()[name])
    columns = [entry[0] for entry in answer.description]
    kinds = {entry[0]: str(entry[1]) for entry in answer.description}
    twin = answer.fetchall()
    if sorted(columns) != sorted(frame.columns):
        return f"COLUMNS differ: {sorted(frame.columns)} / {sorted(columns)}"
    names = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    wrong = [(c, t, kinds[c]) for c, t in frame.dtypes if names.get(t) != kinds[c]]
    if wrong:
        return f"TYPES differ: {wrong}"
    ours, theirs = _canonical(frame.columns, rows), _canonical(columns, twin)
    if ours != theirs:
        lost = [row for row in theirs if row not in set(ours)][:2]
        extra = [row for row in ours if row not in set(theirs)][:2]
        return f"VALUES differ: {len(ours)} / {len(theirs)} rows\n   ours   {extra}\n   theirs {lost}"
    return f"ok ({len(rows)})"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    spark = local_session("check", "8")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{options.sf}/{table}.parquet'")
    failed = 0
    for name in options.names or queries():
        start = time.time()
        try:
            outcome = compare(spark, connection, options.sf, name)
        except Exception as error:  # report and go on with the next query
            outcome = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        failed += not outcome.startswith(("ok", "rows only"))
        print(f"{name:28s} {time.time() - start:6.2f}s  {outcome}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
