import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from quirework.plans import catalog

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else round(v, 6)
    return list(v) if isinstance(v, tuple | list) else v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(plain, r)) for r in df[cols].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(catalog.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() >= 0


def test_text_package_is_optional():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_text_package():
    import pathlib
    import re

    root = pathlib.Path(catalog.__file__).parent.parent
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", f.read_text(), re.M), f
