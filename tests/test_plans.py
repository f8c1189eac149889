"""Physical plans: shuffles, pushdown, no Python stages, bounded broadcasts."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from sqlcorpus.operators import examples, splits, stats
from sqlcorpus.operators import schemas as schema_operators
from sqlcorpus.registry.derived import view
from sqlcorpus.registry.spark_queries import QUERIES

NO_JOB_PLANS = sorted(n for n in QUERIES if not re.match(r"s[2-8]|v1|r14_rewrite_chat", n))


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_JOB_PLANS)
def test_no_python_and_no_cross_join(name, spark, sf):
    plan = physical(contract.queries()[name](spark, sf))
    assert "EvalPython" not in plan and "PandasExec" not in plan and "MapInPandas" not in plan
    assert "CartesianProduct" not in plan
    if "i2_demo" not in name:
        assert "BroadcastNestedLoopJoin" not in plan


def _columns(spark, rows):
    return spark.createDataFrame(rows, "split string, question string, sql string")


def test_leak_check_shuffles_once(spark):
    plan = physical(splits.overlaps(_columns(spark, [("train", "q", "s")]), ["question", "sql"], ("train", "validation", "test")))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Exchange SinglePartition") == 1
    assert "partial_max" in plan and "SortAggregate" not in plan


def test_distribution_collapses_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1)], "split string, v long")
    plan = physical(stats.distribution(df, "split", ["v"]))
    assert "partial_count" in plan and plan.count("Exchange hashpartitioning") <= 2


def test_split_labels_rows_without_shuffling_them(spark, tmp_path):
    spark.range(100).selectExpr("id", "'x' AS label", "'long text' AS body").write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    out = splits.stratified_split(df, "label", strata_bound=5)
    plan = physical(out)
    probe = plan[plan.index("BroadcastHashJoin"):]
    stream_side = probe[: probe.index("BroadcastExchange")]
    assert "Exchange" not in stream_side and "body" in stream_side
    # the passes that find the cut read the stratum and the id only
    assert all("body" not in s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan)[1:])


def test_scans_are_pruned_and_filtered(spark, sf):
    few = view(spark, sf, "examples").where(F.col("id") < 100).select("id")
    plan = physical(few)
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan and "LessThan(o_orderkey,100)" in plan


def test_accounting_joins_counts_only(spark, sf):
    df = contract.queries()["e5_conversion_counts"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    join_at = plan.index("Join LeftOuter")
    assert "Aggregate [source" in plan[:join_at] and "Aggregate [source" in plan[join_at:]


def test_wide_feature_pass_upper_cases_once(spark, sf):
    plan = contract.queries()["f1_f7_features"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bupper\(", plan)) == 1


@pytest.mark.parametrize(
    "name", ["e1_clean_query", "r1_r7_rewrite_query", "r8_r13_rewrite_ddl", "f1_f7_features", "f8_f9_split_class", "x3_normalise"]
)
def test_row_expressions_stay_in_generated_code(name, spark, sf):
    """No expression of the hot projections falls back to interpretation."""
    plan = physical(contract.queries()[name](spark, sf))
    assert not re.search(r"lambdafunction|zip_with\(|transform\(|filter\(", plan)


def _staged_schemas(spark, path):
    spark.createDataFrame([("a", "CREATE TABLE t (x int)", True), ("b", None, False)], "db_id string, ddl string, has_ddl boolean").write.parquet(path)
    return spark.read.parquet(path)


def test_status_and_counts_read_no_schema_text(spark, tmp_path):
    schemas = _staged_schemas(spark, str(tmp_path / "schemas"))
    asked = spark.createDataFrame([(1, "a", "q", "SELECT 1", "train"), (2, "b", "q", "SELECT 1", "train")], "id long, db_id string, question string, query string, source string")
    status = examples.with_status(asked, schemas)
    for df in (status, examples.conversion_counts(asked, schemas)):
        read = re.findall(r"ReadSchema: struct<([^>]*)>", physical(df))
        assert read and all("has_ddl" in s and "ddl:string" not in s for s in read)
    assert {r.id: r.status for r in status.collect()} == {1: examples.WRITTEN, 2: examples.MISSING_SCHEMA}


def test_schema_index_with_its_text_is_not_shuffled(spark, tmp_path):
    index = schema_operators.schema_index(_staged_schemas(spark, str(tmp_path / "schemas")), "ddl")
    plan = physical(index)
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ReadSchema") == 1
    assert [r.ddl for r in index.collect()] == ["CREATE TABLE t (x int)"]
