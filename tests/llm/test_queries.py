import duckdb
import pandas as pd
import pytest

from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_its_sql(spark, name):
    d = "/root/testdata/sf0.001"
    got = queries.queries()[name](spark, d).toPandas()
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = c.sql(queries.oracle_sql()[name]).df()

    def key(df):
        return sorted(repr(tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in row)) for row in df[sorted(df.columns)].itertuples(index=False))

    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want) and len(got) > 20


def test_all_are_there():
    assert [n.split("_")[0] for n in sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))] == [f"op{n}" for n in range(1, 14)]
