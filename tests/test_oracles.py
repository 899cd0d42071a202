"""Every registered query against its SQL on DuckDB."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from rankwright.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    plain = frame.astype(object).where(frame.notna(), None)
    as_text = lambda v: f"{float(v):.9f}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(as_text, r)) for r in plain.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["standardised", "robust_scaled"])
def test_scaling_returns_every_feature_of_every_row(spark, duck, name):
    n = duck.execute("SELECT count(*) FROM embeddings").fetchone()[0]
    got = QUERIES[name](spark, SF).groupBy("feature").count().collect()
    assert {(r.feature, r["count"]) for r in got} == {(f"var_{k}", n) for k in range(64)}
