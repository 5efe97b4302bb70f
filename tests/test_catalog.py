"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from difforge.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(names, data):
    order = [names.index(n) for n in sorted(names)]
    show = lambda x: format(x, ".9g") if isinstance(x, float) else str(x)
    return sorted(tuple("~" if r[i] is None else show(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    data = [tuple(r) for r in got.collect()]
    assert data
    sql = catalog.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.columns, data) == rows(want.columns, want.fetchall())


#: Queries that read whole texts in ways that a few texts only break; on ten times as many documents.
WHOLE_TEXTS = ["suggestion_checks", "syntax_table", "import_table", "syntax_marks", "token_windows", "diff_line_table", "embed_cached"]


@pytest.mark.parametrize("name", WHOLE_TEXTS)
def test_query_on_more_texts(spark, name):
    larger = SF.replace("0.001", "0.01")
    got = catalog.queries()[name](spark, larger)
    data = [tuple(r) for r in got.collect()]
    assert data
    if sql := catalog.oracle_sql().get(name):
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{larger}/documents.parquet'")
        want = c.sql(sql)
        assert rows(got.columns, data) == rows(want.columns, want.fetchall())


def test_all_sql_is_used():
    from difforge.plans.sql import SQL

    assert set(SQL) <= set(catalog.queries())
