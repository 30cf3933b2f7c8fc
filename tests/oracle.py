"""Compares a query's rows with its SQL's, as sets of rows with counts."""

import math
import os
from collections import Counter
from datetime import datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    return float(v)


def compare(spark, sf_dir, run, sql):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    want = con.execute(sql)
    names = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(n) for n in names]
    rows = Counter(tuple(canon(r[i]) for i in order) for r in want.fetchall())
    df = run(spark, sf_dir)
    assert sorted(df.columns) == names, (sorted(df.columns), names)
    got = Counter(tuple(canon(r[n]) for n in names) for r in df.collect())
    lack, extra = rows - got, got - rows
    assert not lack and not extra, (sum(rows.values()), sum(got.values()), list(lack.items())[:3], list(extra.items())[:3])
    return sum(got.values())
