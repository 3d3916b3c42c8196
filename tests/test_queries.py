"""Every registered query against its SQL in DuckDB on the smallest tables; queries without SQL must give rows."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

from coursemill.plans import registered
from coursemill.plans.views import TABLES

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registered()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, dict):
        return str({k: plain(x) for k, x in v.items()})
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "__float__"):
        return f"{float(v):.9g}"
    return str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name not in SQL:
        assert len(got)
        return
    want = duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize(("stream", "batch", "columns"), [("i3_detect_slides_stream", "i3_detect_slides", ["lecture_id", "span_index", "slide_id", "start_s"]), ("i12_sample_per_key_stream", "i12_sample_per_key", ["lecture_id", "page", "t_s", "frame"])])
def test_streams_give_what_batches_give(spark, stream, batch, columns):
    got, want = (QUERIES[n](spark, DIR).select(*columns).toPandas() for n in (stream, batch))
    assert rows(got) == rows(want)
