"""Local check of a registered query against its DuckDB oracle (the driver's rule).

Row count, column names and an order-insensitive multiset of rounded values.
Used by the tests; the driver runs its own copy of the same idea.
"""

from __future__ import annotations

import math

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.collect()]


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, [tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()]


def compare(spark_df, con, sql):
    """Return (ok, message)."""
    scols, srows = rows_of_spark(spark_df)
    dcols, drows = rows_of_duck(con, sql)
    if scols != dcols:
        return False, f"columns differ: spark={scols} duck={dcols}"
    if len(srows) != len(drows):
        return False, f"row count differs: spark={len(srows)} duck={len(drows)}"
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a, b = sorted(srows, key=key), sorted(drows, key=key)
    for x, y in zip(a, b):
        if x != y:
            return False, f"first differing row: spark={x!r:.400} duck={y!r:.400}"
    return True, f"{len(srows)} rows match"


def main(argv=None):
    import sys
    import time

    from shoal.plans.queries import ORACLE, QUERIES
    from shoal.session import ensure_checkpoint_dir, get_session

    args = list(sys.argv[1:] if argv is None else argv)
    sf = "/root/testdata/sf0.01"
    names = [n for n in QUERIES if not args or any(n.startswith(a) for a in args)]
    spark = get_session("shoal-compare", master="local[8]", shuffle_partitions=8)
    ensure_checkpoint_dir(spark)
    con = duck_connect(sf)
    bad = 0
    for n in names:
        t = time.time()
        try:
            df = QUERIES[n](spark, sf)
            if n in ORACLE:
                ok, msg = compare(df, con, ORACLE[n])
            else:
                ok, msg = True, f"{df.count()} rows (no oracle)"
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {n:32s} {time.time() - t:6.1f}s  {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main()
