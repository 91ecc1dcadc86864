"""Every query of the second registry module against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from lodestone.plans import record_queries
from lodestone.plans.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()
NAMES = [n for n, f in QUERIES.items() if f.__module__ == record_queries.__name__]


@pytest.fixture(scope="module")
def tables():
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        yield db


def plain(df):
    """Rows as sorted tuples of texts; numbers without trailing zeros."""
    text = lambda x: "" if pd.isna(x) else f"{float(x):.6f}" if not isinstance(x, str) else x
    return sorted(tuple(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, tables, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), tables.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
