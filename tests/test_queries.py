import duckdb
import pytest

from sheafline import feature_queries, queries

QUERIES, ORACLES = queries.QUERIES | feature_queries.QUERIES, queries.ORACLES | feature_queries.ORACLES


def rows(df, cols):
    df = df[cols].astype(object).where(df[cols].notna(), None)
    return sorted(map(repr, df.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("part", "events", "documents", "labels", "conversations", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
        want = con.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(want.columns))
    else:
        assert len(got)
