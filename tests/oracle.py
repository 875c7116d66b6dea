"""A query and its SQL over the same tables: rows compared as multisets, columns by name."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return tuple(map(plain, value)) if isinstance(value, list) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark, query, sql, folder):
    """(columns differ, rows of the query alone, rows of the SQL alone), some of them."""
    frame = query(spark, folder)
    mine = rows_of(frame.columns, frame.collect())
    got = duck(folder).execute(sql)
    names = [d[0] for d in got.description]
    theirs = rows_of(names, got.fetchall())
    return sorted(names) != sorted(frame.columns), list((mine - theirs).items())[:5], list((theirs - mine).items())[:5]
