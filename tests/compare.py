"""Run a query and its SQL on the same tables and compare the rows, whatever their order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, float):
        return f"{value:.9g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return str(value)


def differences(frame, con, sql):
    got_columns = sorted(frame.columns)
    got = sorted(tuple(plain(r[c]) for c in got_columns) for r in frame.collect())
    relation = con.sql(sql)
    order = sorted(range(len(relation.columns)), key=lambda i: relation.columns[i])
    want = sorted(tuple(plain(r[i]) for i in order) for r in relation.fetchall())
    columns = [relation.columns[i] for i in order]
    if columns != got_columns:
        return f"columns {got_columns} against {columns}"
    if got != want:
        extra, lost = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
        return f"{len(got)} rows against {len(want)}; only in Spark {extra}; only in SQL {lost}"
    return "" if got else "no rows"
