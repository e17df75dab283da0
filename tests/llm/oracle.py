import math

import duckdb

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def both(spark, name, data=DATA):
    """(columns, rows of the query, rows of its oracle), each sorted."""
    got = entry.queries()[name](spark, data)
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("documents", "pages", "labels", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)

    def plain(x):
        return round(x, 9) if isinstance(x, float) and math.isfinite(x) else tuple(map(plain, x)) if isinstance(x, (list, tuple)) else tuple(sorted(x.items())) if isinstance(x, dict) else x

    rows = [sorted((tuple(plain(x) for x in r) for r in rs), key=repr) for rs in (map(tuple, got.select(*columns).collect()), want.fetchall())]
    return columns, *rows
