"""Queries of this subpackage against their SQL on the smallest tables."""

import duckdb
import pytest

from tessera.llm import registry

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    expected = c.execute(registry.oracle_sql()[name])
    columns = [x[0] for x in expected.description]
    df = registry.queries()[name](spark, D)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[x] for x in columns) for r in df.collect()))) == sorted(map(str, expected.fetchall()))


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, len(registry.queries()) + 1))
