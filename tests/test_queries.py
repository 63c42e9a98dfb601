"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from taplight.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def _rows(frame: pd.DataFrame, names: list[str]) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if str(v) in ("True", "False"):
            return str(v)
        return f"{float(v):.6f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    return sorted(tuple(map(plain, r)) for r in frame[names].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert _rows(got, names) == _rows(want, names)


def test_every_query_has_sql_but_the_forest():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"domain_model"}
