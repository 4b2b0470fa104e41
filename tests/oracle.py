"""Runs registered queries next to their SQL in DuckDB and compares the rows.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda t: tuple(map(repr, t)))


_KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float",
}


CLOCK = {"sql": 0.0}


def compare(spark, con, name, job, sql, sf_dir):
    """None when equal, else what differs."""
    got = job(spark, sf_dir)
    want = con.sql(sql)
    kinds = {c: _KINDS.get(str(t), str(t)) for c, t in zip(want.columns, want.types)}
    mine = dict(got.dtypes)
    if sorted(mine) != sorted(kinds):
        return f"columns {sorted(mine)} != {sorted(kinds)}"
    mine_rows = [tuple(r) for r in got.collect()]
    spent = time.time()
    b = rows_of(want.columns, want.fetchall())
    CLOCK["sql"] = time.time() - spent
    a = rows_of(got.columns, mine_rows)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ, first {str(bad[0])[:600]}"
    if mine != kinds:
        return f"types {[(c, mine[c], kinds[c]) for c in mine if mine[c] != kinds[c]]}"
    if not a:
        return "no rows"
    return None


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.lexweave.spread", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    jobs = entry.queries()
    names = argv[1:] or list(jobs)
    failed = []
    for name in names:
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, name, jobs[name], sql[name], sf_dir)
            else:
                problem = None if jobs[name](spark, sf_dir).count() else "no rows"
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        spent = time.time() - start
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {spent:.1f}s (sql {CLOCK['sql']:.1f}s) {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
