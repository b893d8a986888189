import pytest
from tests.conftest import DATA, rows
from voxlake.llm import queries

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_duckdb(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    sql = queries.ORACLE_SQL[name]
    assert {k: KINDS[t] for k, t in got.dtypes} == {r[0]: r[1] for r in duck.execute("DESCRIBE " + sql).fetchall()}
    assert rows(got.toPandas()) == rows(duck.execute(sql).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_returns_every_document(spark, name):
    out = queries.QUERIES[name](spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    assert set(out["doc_id"]) == set(docs["doc_id"])
    if name != "op7_packing":
        assert len(out) == len(docs)


def test_entry_works_without_the_subpackage():
    import subprocess
    import sys

    code = "import re, sys; sys.modules['voxlake.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(re.match(r'op\\d', k) or k == 'pipeline' for k in q)"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0
