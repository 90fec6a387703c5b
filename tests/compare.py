"""Runs registered queries next to their SQL and compares all rows.

    python tests/compare.py SF_DIR [query ...]
"""

import datetime
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


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """None if equal, otherwise what differs."""
    df = query(spark, sf_dir)
    got_cols, got = bag(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want_cols, want = bag([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        only_got, only_want = list((got - want).items()), list((want - got).items())
        return f"{len(only_got)} rows only here, e.g. {only_got[:2]}\n   {len(only_want)} only there, e.g. {only_want[:2]}"
    kinds = [
        {type(r[i]) for r in side if r[i] is not None} for side in (got, want)
        for i in range(len(got_cols))
    ]
    half = len(got_cols)
    mixed = [got_cols[i] for i in range(half) if kinds[i] and kinds[half + i] and kinds[i] != kinds[half + i]]
    return f"types differ in {mixed}" if mixed else None


def main():
    from __spark_entry__ import oracle_sql, queries
    from usemeter.session import build_session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                    "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            diff = compare(spark, con, name, query, sql[name], sf_dir) if name in sql else "no SQL"
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        bad += diff is not None and diff != "no SQL"
        mark = "ok  " if diff is None else "--  " if diff == "no SQL" else "DIFF"
        print(f"{mark} {name:24s} {time.time() - start:6.2f}s {diff or ''}",
              flush=True)
    print(f"{bad} differ")
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
