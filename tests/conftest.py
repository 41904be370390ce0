from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s


def normal(x):
    """Values of both engines in one form."""
    if x is None or x != x:
        return None
    if isinstance(x, (list, tuple)):
        return tuple(normal(i) for i in x)
    if isinstance(x, bool):
        return x
    return round(x, 9) if isinstance(x, float) else x


def rows(df):
    """Rows of a DataFrame with columns by name, sorted."""
    cols = sorted(df.columns)
    return cols, sorted((tuple(normal(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=lambda r: tuple(map(str, r)))


def duck_rows(sql, folder=DATA):
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    r = con.sql(sql)
    cols = sorted(r.columns)
    pick = ", ".join(f'"{c}"' for c in cols)
    return cols, sorted((tuple(normal(v) for v in x) for x in con.sql(f"select {pick} from ({sql})").fetchall()), key=lambda r: tuple(map(str, r)))
