"""Every archive query against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from turnlake.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, duck, name):
    got, want = queries()[name](spark, DATA).toPandas(), duck.sql(oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    frames = [f[columns].astype(object).where(f[columns].notna(), None).sort_values(columns, ignore_index=True, key=lambda s: s.astype(str)) for f in (got, want)]
    pd.testing.assert_frame_equal(*[f.map(lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x if x is None else str(x)) for f in frames], check_dtype=False)
