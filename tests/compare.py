"""A query's rows against its SQL's rows in DuckDB, as the driver compares them."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        src = p if os.path.isfile(p) else f"{p}/*.parquet"
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS FROM '{src}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if isinstance(x, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if hasattr(x, "tzinfo") and x.tzinfo is not None:
        import datetime

        return x.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr), [names[i] for i in order]


def differences(spark_df, sql, con):
    got, gn = rows(spark_df.columns, spark_df.collect())
    cur = con.execute(sql)
    want, wn = rows([x[0] for x in cur.description], cur.fetchall())
    if gn != wn:
        return f"columns {gn} and {wn}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"rows {len(got)} and {len(want)}; only ours {sorted(a - b)[:4]}; only SQL {sorted(b - a)[:4]}"
    return ""
