"""Queries against their SQL on tables with what larger ones have and the smallest lack."""

import ipaddress

import duckdb
import pytest
from pyspark.sql import functions as F

from taplight.plans import catalog
from taplight.sources import shared, views

SMALL = "/root/testdata/sf0.001"


def _equal(spark, folder, name, tables=("events",)):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    result = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted(map(repr, result.fetchall()))
    return sorted(repr(tuple(r)) for r in catalog.QUERIES[name](spark, folder).select(*names).collect()) == want


@pytest.fixture(scope="module")
def many_users(spark, tmp_path_factory):
    """Events of users whose numbers don't fit in a byte."""
    folder = str(tmp_path_factory.mktemp("users"))
    spark.read.parquet(f"{SMALL}/events.parquet").withColumn("user_id", F.col("user_id") * 700).write.parquet(f"{folder}/events.parquet")
    return folder


def test_each_user_has_an_address(spark):
    users = [0, 255, 256, 257, 65536, (1 << 24) - 1, 1 << 24, 1 << 40, -1]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in users], "u long").select(views.address(F.col("u"))).collect()]
    assert len({ipaddress.ip_address(a) for a in got}) == len(users)
    assert got[:3] == ["10.0.0.0", "10.0.0.255", "10.0.1.0"]


@pytest.mark.parametrize("name", ["flow_observations", "log_diagnostics", "dns_observations", "observation_kinds"])
def test_users_beyond_a_byte(spark, many_users, name):
    assert _equal(spark, many_users, name)


def test_corpus_without_benign_names(spark, tmp_path):
    """Pages all of whose names a family claims."""
    spark.read.parquet(f"{SMALL}/pages.parquet").where("page_id % 3 = 0").write.parquet(f"{tmp_path}/pages.parquet")
    assert _equal(spark, str(tmp_path), "corpus_sizes", ["pages"])


def test_a_part_of_several_files_is_one_micro_batch(spark, many_users):
    with shared.settings(spark, {"spark.sql.files.maxRecordsPerFile": "60"}):
        assert _equal(spark, many_users, "stream_late")
