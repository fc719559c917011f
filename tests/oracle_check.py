"""Run catalog queries next to their SQL counterparts and compare names, rows and values."""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import date, datetime

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{os.path.join(sf_dir, name)}.parquet'")
    return con


def plain(value):
    """A comparable form that keeps full precision."""
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return float(value)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value if isinstance(value, str) else float(value)


def normal(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(spark_df, con, sql: str) -> str | None:
    rel = con.sql(sql)
    names, rows = list(rel.columns), rel.fetchall()
    ours = [tuple(r) for r in spark_df.collect()]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    if len(ours) != len(rows):
        return f"{len(ours)} rows against {len(rows)}"
    a, b = normal(spark_df.columns, ours), normal(names, rows)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} rows differ, first {wrong[0]} in {sorted(names)}" if wrong else None


def main(sf_dir: str, only: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from cardwarden.session import build_session

    spark = build_session("oracle-check", "local[8]", 8, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if only and name not in only:
            continue
        begin = time.time()
        try:
            df = fn(spark, sf_dir)
            found = differences(df, con, sql[name]) if name in sql else f"rows only: {df.count()}"
        except Exception as error:
            found = f"error {type(error).__name__}: {str(error)[:600]}"
        ok = found is None or found.startswith("rows only")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - begin:.2f}s {found or ''}", flush=True)
    print("failed:", failed, "without sql:", sorted(set(queries()) - set(sql)),
          "sql without query:", sorted(set(sql) - set(queries())))
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
