"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from provsight.plans import inputs, registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in inputs.TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(str(r[k]) for k in order) for r in data))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_bucketed_fingerprint_is_stable(spark):
    from provsight.operators.rollup import bucketed_fingerprint

    docs = inputs.frame(spark, SF, "documents")
    a, b = (sorted(map(tuple, bucketed_fingerprint(d, "source", "doc_id", "text").collect())) for d in (docs, docs.repartition(7)))
    assert a == b


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
