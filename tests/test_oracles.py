"""Every query with SQL against DuckDB, over whole tables."""

import duckdb
import pytest

from shelfwise.plans import catalogue, desk, kept  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(df, columns):
    df = df[columns].copy()
    for c in columns:
        if df[c].dtype.kind in "if" or str(df[c].dtype).startswith(("Int", "Float")):
            df[c] = df[c].astype("float64")
    df = df.astype(str).replace({"nan": "<NA>", "None": "<NA>", "NaT": "<NA>"})
    return df.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = db.sql(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert _plain(got, columns).equals(_plain(want, columns))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
