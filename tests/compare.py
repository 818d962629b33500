"""Rows of a DataFrame against rows of a DuckDB statement over the same files."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder=DATA):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        files = glob.glob(f"{path}/*.parquet") or [path]
        if os.path.exists(files[0]):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
    return c


def _plain(x):
    if x is None or repr(x) in ("<NA>", "NaT") or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "isoformat"):
        return str(x)[:19]
    x = x.item() if hasattr(x, "item") else x
    return float(f"{x:.9g}") if isinstance(x, float) else x


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(map(_plain, r)) for r in frame[columns].astype(object).values.tolist()), key=repr)
