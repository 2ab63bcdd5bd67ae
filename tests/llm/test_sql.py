"""Registered queries beside their SQL, on the smallest data folder."""

import duckdb
import pytest

from conftest import SF
from hostlens.llm.queries import REGISTRY


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_against_sql(spark, duck, name):
    run, sql = REGISTRY[name]
    df, rel = run(spark, SF), duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(map(str, rel.fetchall()))
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == want
