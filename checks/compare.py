"""Run queries on Spark and on DuckDB and compare their rows.

    python -m checks.compare [sf dir] [query ...]
"""

from __future__ import annotations

import sys
import time
import traceback

from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    return float(value) if isinstance(value, float) else value


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark: SparkSession, con, sf_dir: str, function, sql: str) -> str | None:
    """What differs between a query and its SQL; None if nothing does."""
    df = function(spark, sf_dir)
    mine = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = sorted_rows(names, found.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} against {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows against {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1]):
        if repr(a) != repr(b):
            return f"row {a} against {b}"
    return None


def main(argv: list[str]) -> int:
    from checks import ORACLES, QUERIES
    from checks.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con = local_session("8"), oracle_connection(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                problem = difference(spark, con, sf_dir, QUERIES[name], ORACLES[name])
                n = con.execute(f"SELECT count(*) FROM ({ORACLES[name]})").fetchone()[0]
            else:
                n, problem = len(QUERIES[name](spark, sf_dir).collect()), None
        except Exception as error:  # noqa: BLE001
            n, problem = 0, f"{type(error).__name__}: {str(error)[:600]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:34s} {n:8d} rows {time.time() - start:6.2f} s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} queries agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main([a for a in sys.argv[1:] if a != "-v"]) else 0)
