"""Rows of a Spark frame against those of DuckDB SQL, whatever their order."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    return str(value)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, Counter(repr([plain(x) for x in r]) for r in df.select(*(f"`{n}`" for n in names)).collect())


def rows_of_duckdb(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return sorted(found.columns), Counter(repr([plain(r[i]) for i in order]) for r in found.fetchall())
