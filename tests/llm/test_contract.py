"""Registration of the queries, and the SQL of those that have one."""

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from plumbline.llm import queries


def test_all_queries_are_registered():
    names = contract.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and len(corpus_pipeline.STAGES) == 5
    assert set(contract.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, data_dir, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{data_dir}/documents.parquet'")
    cursor = con.execute(queries.SQL[name])
    columns = [c[0] for c in cursor.description]
    got = queries.QUERIES[name](spark, data_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(cursor.fetchall())
