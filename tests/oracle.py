"""Compare a query's rows with its SQL's on DuckDB."""

import glob
import math
import os


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from '{path}{'/*' if os.path.isdir(path) else ''}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "missing"
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(names, found):
    return sorted((tuple(map(_plain, r)) for r in found), key=str) if names else []


def same(con, sql, df):
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*(f"`{n}`" for n in names)).collect()]
    cur = con.execute(sql)
    theirs = [d[0] for d in cur.description]
    assert sorted(theirs) == names
    order = [theirs.index(n) for n in names]
    want = [tuple(r[k] for k in order) for r in cur.fetchall()]
    assert rows(names, got) == rows(names, want)
