import os

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_catalogue_queries_equal_their_sql(spark):
    import duckdb
    import pandas as pd

    from provlake.plans.queries import ORACLE_SQL, QUERIES

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")

    def shown(df):
        df = df[sorted(df.columns)].astype(object)
        text = lambda x: "" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
        return list(df.columns), sorted(tuple(map(text, r)) for r in df.itertuples(index=False))

    wrong = [n for n, f in QUERIES.items() if shown(f(spark, DATA).toPandas()) != shown(db.sql(ORACLE_SQL[n]).df())]
    assert not wrong


def test_entry_imports():
    import __spark_entry__ as entry

    assert "subjects_counts" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
