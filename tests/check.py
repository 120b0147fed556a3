"""Compare registered queries with their SQL, the way the driver does."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, (dt.date, dt.datetime, Decimal)):
        return f"{type(v).__name__}{v}"
    return repr(v)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(
        tuple(norm(r[i]) for i in order) for r in rows
    )


def oracle(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    return bag(cols, res.fetchall())


def compare(spark, sf_dir: str, fn, sql: str) -> str | None:
    df = fn(spark, sf_dir)
    got_cols, got = bag(df.columns, [tuple(r) for r in df.collect()])
    want_cols, want = oracle(sf_dir, sql)
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    if sum(got.values()) == 0:
        return "no rows" if sum(want.values()) else None
    if got != want:
        extra, lacking = got - want, want - got
        return (
            f"rows {sum(got.values())} vs {sum(want.values())}; "
            f"{sum(extra.values())} extra e.g. {list(extra)[:2]}; "
            f"{sum(lacking.values())} lacking e.g. {list(lacking)[:2]}"
        )
    return None


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel(os.environ.get("LOG", "ERROR"))
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = session()
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            if name in sqls:
                problem = compare(spark, sf_dir, fn, sqls[name])
            else:
                problem = None if fn(spark, sf_dir).count() > 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'OK ' if problem is None else 'BAD'} {name} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
