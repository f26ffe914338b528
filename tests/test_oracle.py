"""Every registered query against its SQL on the smallest tables."""

import pytest

from articlelake.plans import REGISTRY
from compare import oracle, spark_rows


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, small, name):
    q = REGISTRY[name]
    columns, rows = spark_rows(q.run(spark, small))
    assert columns
    if q.sql is not None:
        expected_columns, expected = oracle(small, q.sql)
        assert columns == expected_columns
        assert rows == expected


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["qid", "id", "where_found", "added_at"]


def test_backlog(spark, small):
    from articlelake.plans.images import BACKLOG

    assert spark_rows(REGISTRY["backlog_plan"].run(spark, small)) == oracle(small, f"{BACKLOG} SELECT * FROM planned")
    totals = REGISTRY["backlog_totals"].run(spark, small).first().asDict()
    plan = REGISTRY["backlog_plan"].run(spark, small).groupBy("decision").count().collect()
    assert {r["decision"]: r["count"] for r in plan} == {k: v for k, v in totals.items() if k != "bytes"}
