"""Registered queries of the subpackage: SQL where there is some, else one row per input row, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from memspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def values(df):
    return sorted(([None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v for v in r] for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), c.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and values(got) == values(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_covers_the_table(spark, name):
    key = "page_id" if name == "op8_html" else "doc_id"
    table = spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    got = QUERIES[name](spark, SF)
    assert {r[0] for r in got.select(key).collect()} == {r[0] for r in table.select(key).collect()}
    if name != "op7_packing":
        assert got.count() == table.count()
