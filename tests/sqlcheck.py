"""Rows of a query beside those of its SQL."""

import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


def ordered(names, rows):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


def same(frame, con, sql):
    """Columns and rows are equal, in any order."""
    found = con.execute(sql)
    names, rows = [c[0] for c in found.description], found.fetchall()
    assert sorted(frame.columns) == sorted(names)
    assert ordered(frame.columns, [tuple(r) for r in frame.collect()]) == ordered(names, rows)
