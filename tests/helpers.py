"""Bars for tests, and a comparison of a query with its SQL."""

from datetime import datetime, timedelta

import duckdb
import pandas as pd

from barloom.schema import BAR_SCHEMA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def minute_bars(spark, start, n, symbol="X", price=lambda i: 150 + 0.01 * i, keep=lambda t: True):
    t0 = datetime.fromisoformat(start)
    rows = []
    for i in range(n):
        t = t0 + timedelta(minutes=i)
        if keep(t):
            p = price(i)
            bid = (p, p + 0.5, p - 0.5, p + 0.2)
            rows.append((symbol, t, t + timedelta(minutes=1), *bid, *(x + 0.02 for x in bid), 10.0))
    return spark.createDataFrame(rows, BAR_SCHEMA)


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).fetchdf()


def rows(df: pd.DataFrame):
    names = sorted(df.columns)
    return names, sorted(map(repr, df[names].astype(object).where(df[names].notna(), None).itertuples(index=False, name=None)))
