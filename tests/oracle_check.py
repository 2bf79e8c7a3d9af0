"""Run registered queries next to their SQL and compare: rows, columns, values.

``python tests/oracle_check.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _cell(value):
    if value is None:
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    if value.__class__.__name__ == "Decimal":
        return round(float(value), 9)
    if value.__class__.__name__ in ("Timestamp", "datetime"):
        return value.isoformat()[:26]
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def compare(df, con, sql: str) -> tuple[bool, str, int]:
    spark_rows = df.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    duck_rows = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}", len(spark_rows)
    if len(spark_rows) != len(duck_rows):
        note = f"rows {len(spark_rows)} vs {len(duck_rows)}"
    else:
        note = ""
    left, right = rows_of(df.columns, spark_rows), rows_of(names, duck_rows)
    if left == right:
        types = {n: t for n, t in zip(names, (str(d[1]) for d in result.description))}
        return True, str({c: (t, types[c]) for c, t in df.dtypes}) if os.environ.get("TYPES") else "", len(spark_rows)
    a, b = list((left - right).items())[:2], list((right - left).items())[:2]
    return False, f"{note} diff={sum((left - right).values())}\n   spark {str(a)[:700]}\n   duck  {str(b)[:700]}", len(spark_rows)


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from vakanz.session import get_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = get_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    con = connect(sf_dir)
    wanted = [q for q in queries if not argv[1:] or any(q == a or (a.endswith("*") and q.startswith(a[:-1])) for a in argv[1:])]
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sql:
                ok, note, n = compare(df, con, sql[name])
            else:
                n = len(df.collect())
                ok, note = True, "(rows only)"
        except Exception as exc:  # report and go on with the next query
            ok, note, n = False, f"{type(exc).__name__}: {str(exc)[:900]}", -1
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:26s} rows={n:<7d} {time.time() - start:5.1f}s {note}", flush=True)
    print(f"{len(wanted) - bad}/{len(wanted)} match")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
