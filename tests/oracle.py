"""Compare a query with its SQL twin, value by value and type by type."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return ("float", "nan" if math.isnan(value) else float(f"{value:.9g}"))
    return (type(value).__name__, str(value))


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)


def same(spark_df, con, sql):
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    expected = table(found.fetchall(), columns)
    assert sorted(spark_df.columns) == sorted(columns)
    assert table(spark_df.collect(), spark_df.columns) == expected
