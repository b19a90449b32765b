import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
SOME = ["e2_add_dedup", "e8_event_stats", "c5_negative_edges", "c9_maintain", "q4_fusion_adaptive", "q9_batch_vectors", "v12_cell_search", "s14_wal_replay", "st_stream_edges", "a8_command"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(None if pd.isna(v) else round(v, 4) if isinstance(v, float) else v for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, tables, name):
    got = entry.queries()[name](spark, FOLDER)
    want = tables.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want.df())


def test_flagship_and_names(spark):
    assert entry.entry(spark).columns == ["item_id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
