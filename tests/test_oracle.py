"""Registered queries vs their DuckDB SQL on the smallest data set (the driver's check)."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from flowlens.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
NAMES = ["flow_extract", "label_flows", "attack_intervals", "kpis", "flows_page", "timeline", "events_feed",
         "roc_auc", "f1_weighted", "stratified_split", "sequence_windows", "capture_summary", "scan_pcap"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_sql_or_is_rows_only():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 90


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    s = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(E.oracle_sql()[name])
    idx = [rel.columns.index(c) for c in cols]
    o = sorted((tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)
    assert sorted(rel.columns) == cols
    assert s == o


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 894 and "label" in df.columns


@pytest.mark.parametrize("name", ["epoch_to_ts", "events_feed", "timeline", "label_flows", "attack_intervals"])
def test_results_do_not_depend_on_session_time_zone(spark, con, name):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        test_query_matches_oracle(spark, con, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
