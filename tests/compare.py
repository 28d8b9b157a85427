"""Order-free comparison of frames with rounding."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float | int | Decimal):
        return repr(round(float(x), 5) + 0.0)
    if isinstance(x, datetime.datetime | datetime.date):
        return x.isoformat()
    return str(x)


def rows(names: list[str], records) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in records)


def duck(sf: str, sql: str) -> tuple[list[str], list[tuple]]:
    import os

    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{sf}/{name}.parquet"
        con.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = con.execute(sql)
    return [c[0] for c in got.description], got.fetchall()
