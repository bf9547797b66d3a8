"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import decimal
import math


def norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float) and v == 0.0:
        return 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (dt.datetime,)):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def key_of(row):
    return tuple((0, "") if x is None else (1, repr(x) if not isinstance(x, (int, float)) else "%.9e" % x)
                 for x in row)


def close(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b or abs(a - b) <= 1e-6 * max(1.0, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    return a == b


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in records]
    out.sort(key=key_of)
    return [cols[i] for i in order], out


def compare(spark_df, con, sql: str) -> tuple[str, int, int]:
    """Run both sides; return (status, spark_rows, oracle_rows); status OK / OK~tol / MISMATCH / COLUMNS."""
    srec = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drec = res.fetchall()
    sc, sr = rows_of(spark_df.columns, srec)
    dc, dr = rows_of(dcols, drec)
    if sc != dc:
        return "COLUMNS", len(sr), len(dr)
    if sr == dr:
        return "OK", len(sr), len(dr)
    tol = len(sr) == len(dr) and all(close(a, b) for a, b in zip(sr, dr))
    return ("OK~tol" if tol else "MISMATCH"), len(sr), len(dr)


def duck_connection(sf_dir: str):
    import duckdb

    from freshlane.sources.driver import DRIVER_TABLES, table_path
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con
