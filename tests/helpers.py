"""Order-insensitive result comparison, as the correctness gate does it."""

from __future__ import annotations

import datetime as dt
import decimal


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def spark_bag(df):
    return sorted(df.columns), bag(df.columns, [tuple(r) for r in df.collect()])


def duck_bag(con, sql):
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    return sorted(cols), bag(cols, res.fetchall())
