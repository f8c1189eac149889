"""Tables of one row group: their rows are dealt over all cores before long texts are made of them."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from sqlcorpus.registry.derived import schemas, table, view

#: Queries whose plan shows the reads.
DEALT = ["r16_rewrite_accounting", "r19_residue_after", "i4_training_text", "r8_drop_inserts", "d6_schema_index", "d2_column_names"]


@pytest.fixture(scope="module")
def one_group(spark, tmp_path_factory):
    """Customers and orders in one file of one row group each, with a repeated and a null key."""
    at = tmp_path_factory.mktemp("one-group")
    customers = spark.range(200).selectExpr("if(id = 7, 6, id) AS c_custkey", "concat('c', id) AS c_name", "'M' AS c_mktsegment")
    customers.coalesce(1).write.parquet(str(at / "customer.parquet"))
    orders = spark.range(400).selectExpr("if(id = 9, null, id) AS o_orderkey", "id % 200 AS o_custkey")
    orders.coalesce(1).write.parquet(str(at / "orders.parquet"))
    return str(at)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, source", [("schema_files", "customer"), ("examples", "orders")])
def test_rows_are_dealt_and_none_is_lost(name, source, spark, one_group):
    rows = view(spark, one_group, name)
    sizes = [r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) > 4 and max(sizes) < sum(sizes) / 4
    assert sum(sizes) == table(spark, one_group, source).count()


@pytest.mark.parametrize("name", DEALT)
def test_reads_of_a_query_are_dealt(name, spark, one_group):
    plan = physical(contract.queries()[name](spark, one_group))
    assert "RoundRobinPartitioning" in plan


def test_texts_are_made_after_the_rows_are_dealt(spark, one_group):
    plan = physical(schemas(spark, one_group).select(F.md5("ddl")))
    assert plan.index("md5(") < plan.index("RoundRobinPartitioning") < plan.index("Scan parquet")


def test_schema_index_is_written_by_many_tasks(spark, one_group):
    written = contract.queries()["s7_write_schema_index"](spark, one_group)
    assert len(written.inputFiles()) > 4 and written.count() == schemas(spark, one_group).count()
