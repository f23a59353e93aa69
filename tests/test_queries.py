"""Every registered query against its SQL twin, on the driver's smallest tables."""

import datetime as dt
import glob
import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lumafind.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list):
        return str(value)
    if value is None or (not isinstance(value, str) and pd.isna(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return "~" if math.isnan(value) else f"{float(value):.9g}"
    if isinstance(value, dt.date):
        return str(pd.Timestamp(value).tz_localize(None))
    return str(value)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    found = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.SQL:
        want = duck.execute(registry.SQL[name]).df()
        assert sorted(found.columns) == sorted(want.columns)
        assert rows(found) == rows(want)
    else:
        assert len(found)
