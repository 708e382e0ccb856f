"""Compare a frame with DuckDB SQL over the same tables."""

import decimal
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder=DATA):
    db = duckdb.connect()
    db.execute("set TimeZone='UTC'")
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        db.execute(f"create view {t} as select * from '{p}/*.parquet'" if os.path.isdir(p) else f"create view {t} as select * from '{p}'")
    return db


def plain(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, int):
        return f"{v:.9g}" if abs(v) > 2**53 else str(v) if abs(v) >= 10**9 else f"{float(v):.9g}"
    if hasattr(v, "asDict"):
        return plain(list(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if hasattr(v, "isoformat"):
        return str(v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v)
    return repr(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(str([plain(r[c]) for c in cols]) for r in df.collect())


def rows_of_sql(db, sql):
    rel = db.execute(sql)
    names = [d[0] for d in rel.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted(str([plain(r[i]) for i in order]) for r in rel.fetchall())
