import duckdb
import pytest
from emberline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for name_ in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {name_} AS SELECT * FROM '{small}/{name_}.parquet'")
    df, rel = queries.queries()[name](spark, small), con.sql(queries.oracle_sql()[name])
    cols = [c for c in sorted(rel.columns) if c in df.columns]
    assert cols == sorted(df.columns)
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(map(str, rel.select(*cols).fetchall()))
