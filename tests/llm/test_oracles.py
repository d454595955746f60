import duckdb
import pytest

from seriesmill.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, small, name):
    c = duckdb.connect()
    for t in ("benchmark", "conversations", "documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    c.execute(ORACLES[name])
    columns = sorted(d[0] for d in c.description)
    at = [[d[0] for d in c.description].index(k) for k in columns]
    want = sorted((tuple(r[k] for k in at) for r in c.fetchall()), key=str)
    df = QUERIES[name](spark, small)
    assert sorted(df.columns) == columns
    assert sorted((tuple(r[k] for k in columns) for r in df.collect()), key=str) == want
