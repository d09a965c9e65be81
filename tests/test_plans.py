"""Every plan against the SQL that states its result, and the plans that have none."""

import pytest

from leafspan.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_plan_equals_sql(spark, same, name):
    assert same(catalogue.QUERIES[name](spark, str(DATA)), catalogue.SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_plan_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    plan = catalogue.QUERIES["toc_dividers"](spark, str(DATA))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_chapters_need_no_range_join(spark):
    plan = catalogue.QUERIES["chapters"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
