"""Streaming queries vs their DuckDB SQL on the smallest data set."""
import duckdb
import pytest

import __spark_entry__ as E
from flowlens.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["retrain_every_n", "tumbling_segments"])
def test_stream_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    rel = con.sql(E.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    got, want = sorted(map(tuple, df.select(*rel.columns).collect())), sorted(rel.fetchall())
    assert len(want) > 12 and got == want
