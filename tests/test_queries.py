"""Every registered query with SQL equals it on the smallest tables; all queries run."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from memspark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Wide jobs that other tests cover.
SLOW = {"f12_index_units", "g4_list_contexts", "c9_chunk_units", "e13_answer_prompts", "f15_stream_runs"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)[:26] if hasattr(v, "isoformat") else round(v, 9) if isinstance(v, float) else v


def rows(df):
    names = sorted(df.columns)
    return names, sorted(([plain(v) for v in r] for r in df[names].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(duck.execute(ORACLES[name]).df())
    else:
        assert len(got) > 0
