"""Run registered queries next to their SQL and compare the results value by value."""

from __future__ import annotations

import math
import signal
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


# Seconds after which a query is given up.
LIMIT = 120


def _late(*_):
    raise TimeoutError("over the time limit")


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    return value


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=lambda t: tuple((v is None, str(type(v)), str(v)) for v in t))


def run_sql(sf_dir: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return columns, cursor.fetchall()


def kind(value) -> str:
    return "none" if value is None else "bool" if isinstance(value, bool) else type(value).__name__


def compare(df, sf_dir: str, sql: str) -> str:
    """'' when equal, else a short description of the first difference."""
    found = df.collect()
    columns, rows = run_sql(sf_dir, sql)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} <> {sorted(columns)}"
    left, right = canonical(found, df.columns), canonical(rows, columns)
    if len(left) != len(right):
        return f"rows {len(left)} <> {len(right)}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b or [kind(x) for x in a] != [kind(x) for x in b]]
    return f"{len(wrong)} of {len(left)} differ: {wrong[0][0]} <> {wrong[0][1]}" if wrong else ""


def main(spark, sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    signal.signal(signal.SIGALRM, _late)
    bad = 0
    for name in names or queries:
        start = time.time()
        signal.alarm(LIMIT)
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                problem = compare(df, sf_dir, oracle[name])
                state = "ok" if not problem else "DIFF " + problem[:700]
            else:
                state = f"rows {len(df.collect())}"
        except Exception as error:  # report and go on with the next query
            state = "FAIL " + str(error)[:1200]
            spark.sparkContext.cancelAllJobs()
        finally:
            signal.alarm(0)
        bad += state.startswith(("DIFF", "FAIL"))
        print(f"{name:28s} {time.time() - start:6.1f}s {state}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from cellsight.session import get_session

    session = get_session(
        "check", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    sys.exit(1 if main(session, sys.argv[1], sys.argv[2:]) else 0)
