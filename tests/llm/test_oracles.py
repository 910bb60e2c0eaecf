"""The queries that SQL can express, on DuckDB."""

import duckdb
import pytest

from tidewake.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=key)
