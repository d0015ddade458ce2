"""Run registered queries next to their SQL: python tests/check_queries.py FOLDER [NAME...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402
from tests.conftest import make_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(row[i] for i in order)) for row in rows)


def compare(spark, folder, name, query, sql):
    started = time.time()
    frame = query(spark, folder)
    rows = [tuple(row) for row in frame.collect()]
    spent = time.time() - started
    if sql is None:
        return f"rows-only {len(rows)} rows", spent, True
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    answer = duck.execute(sql)
    names = [column[0] for column in answer.description]
    kinds = dict(zip(names, [str(column[1]) for column in answer.description]))
    expected = answer.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}", spent, False
    ours, theirs = normal(rows, frame.columns), normal(expected, names)
    if ours == theirs:
        types = [f"{n}:{t}/{kinds[n]}" for n, t in frame.dtypes]
        return f"ok {len(rows)} rows  {' '.join(types)}", spent, True
    missing = sorted(set(theirs) - set(ours))[:2]
    extra = sorted(set(ours) - set(theirs))[:2]
    return f"DIFFERS {len(rows)} vs {len(expected)}\n  extra {extra}\n  missing {missing}", spent, False


def main(folder, *chosen):
    spark = make_session()
    sql = contract.oracle_sql()
    failed = []
    for name, query in contract.queries().items():
        if name.startswith("op") or name == "pipeline":  # checked in tests/llm
            continue
        if chosen and name not in chosen:
            continue
        try:
            message, spent, good = compare(spark, folder, name, query, sql.get(name))
        except Exception as error:  # keep going, report at the end
            message, spent, good = f"ERROR {str(error)[:1500]}", 0.0, False
        print(f"{name:24s} {spent:6.2f}s {message[:1800]}", flush=True)
        if not good:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
