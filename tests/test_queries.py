"""Every core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from lumentext.plans import answering
from lumentext.plans.oracles import oracle_sql as core_sql
from lumentext.plans.queries import queries


def oracle_sql():
    return core_sql() | answering.sql()


def level(df):
    def one(v):
        if v is None or isinstance(v, (float, np.floating)) and np.isnan(v):
            return None
        return round(float(v), 5) if isinstance(v, (float, np.floating)) else int(v) if isinstance(v, np.integer) else v

    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(one, r))) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, duck, data, name):
    got = queries()[name](spark, data).toPandas()
    want = duck.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert level(got) == level(want)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, data, name):
    assert queries()[name](spark, data).count() > 0


def test_llm_is_optional():
    for root, _, names in os.walk(os.path.join(os.path.dirname(__file__), "..", "lumentext")):
        for n in names:
            if n.endswith(".py") and os.path.basename(root) != "llm":
                assert ".llm" not in open(os.path.join(root, n), encoding="utf-8").read()
