"""Every query of the library against its SQL on DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

from tidewake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    fix = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else float(v) if type(v).__name__ == "Decimal" else v
    return sorted((tuple(map(fix, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_each_has_an_oracle():
    assert set(registry.ORACLE_SQL) == set(registry.QUERIES)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert plain([r[c] for c in cols] for r in df.collect()) == plain([r[i] for i in order] for r in rel.fetchall())


def test_partitioning_changes_nothing(spark):
    """The same rows in another order and number of partitions give the same islands, windows and samples."""
    import tidewake.plans.track as track
    from tidewake.plans import trajectory

    real = track.frames
    for name in ("continuity_islands", "observation_windows", "movement_events", "asof_backward"):
        want = plain(trajectory.QUERIES[name](spark, SF).collect())
        try:
            trajectory.frames = lambda s, d: real(s, d).repartition(7).sortWithinPartitions("value")
            assert plain(trajectory.QUERIES[name](spark, SF).collect()) == want
        finally:
            trajectory.frames = real
