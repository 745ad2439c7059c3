"""Every track query runs, and gives what its SQL gives in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from permaway import registry

NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return c


def normal(frame):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, duck, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert len(got) > 0
    if sql := registry.oracle_sql().get(name):
        want = duck.execute(sql).fetchdf()
        assert sorted(want.columns) == sorted(got.columns)
        assert normal(got) == normal(want)


def test_drawn_tables_keep_the_sign_of_zero(spark, tmp_path):
    """Around user 33000 the tracks meet the equator, some points from the south: -0.00000000 in their tables."""
    path = str(tmp_path / "events.parquet")
    c = duckdb.connect()
    c.execute(f"copy (select k as event_id, timestamp '2024-01-01' + interval 1 second * k as ts, 32993 + k % 10 as user_id, 'a' as event_type, k / 4e0 as value, '' as props from range(300) as r(k)) to '{path}' (format parquet)")
    c.execute(f"create view events as select * from '{path}'")
    sql = registry.oracle_sql()["lines_archive"]
    assert ",-0.00000000," in c.execute(sql.replace("md5(content)", "content")).fetchone()[1]
    assert normal(registry.lines_archive(spark, str(tmp_path)).toPandas()) == normal(c.execute(sql).fetchdf())
