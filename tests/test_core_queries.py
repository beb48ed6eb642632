"""Every registered core query against its SQL."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from leakloom.plans import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SMALL).toPandas()
    assert len(got) or name in ("incremental_blobs",)
    if name in queries.SQL:
        db = duckdb.connect()
        for f in glob.glob(f"{SMALL}/*.parquet"):
            db.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        want = db.sql(queries.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        plain = lambda v: None if not isinstance(v, list) and pd.isna(v) else v  # noqa: E731  # the one engine gives nan for a null, the other None
        rows = lambda x: sorted(str([plain(v) for v in r]) for r in x[sorted(x.columns)].values.tolist())
        assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.SQL)


def test_entry_works_without_the_training_data_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
