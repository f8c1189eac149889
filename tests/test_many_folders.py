"""A folder per database: listed and written by a bounded number of tasks, none by one."""

import glob
import os

import pytest
from pyspark.errors import AnalysisException

from sqlcorpus.registry import spark_queries
from sqlcorpus.sources import readers, writers


def tasks_of_listing(spark, read):
    """Tasks of the jobs that ``read`` starts, and its rows."""
    group = f"listing-{id(read)}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        df = read()
        tracker = spark.sparkContext.statusTracker()
        stages = [s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds]
        return sum(tracker.getStageInfo(s).numTasks for s in stages), df
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def corpus(spark, path, n):
    rows = spark.range(n).selectExpr("concat('db ', id) AS db_id", "concat('CREATE TABLE t', id, ' (x int);') AS ddl")
    writers.write_ddl_corpus(rows, path)
    return {(r.db_id, r.ddl) for r in rows.collect()}


def test_outcomes_are_listed_by_few_tasks(spark, tmp_path):
    expected = corpus(spark, str(tmp_path / "ddl"), 150)
    tasks, back = tasks_of_listing(spark, lambda: readers.ddl_outcomes(spark, str(tmp_path / "ddl"), "*.txt"))
    assert tasks <= 2 * 4 * spark.sparkContext.defaultParallelism  # all files, and the DDL files
    assert {(r.db_id, r.ddl.rstrip("\n")) for r in back.collect()} == expected


def test_ddl_corpus_is_listed_by_few_tasks(spark, tmp_path):
    expected = corpus(spark, str(tmp_path / "ddl"), 150)
    before = spark.conf.get(readers.LISTING)
    tasks, back = tasks_of_listing(spark, lambda: readers.read_ddl_corpus(spark, str(tmp_path / "ddl"), "*.txt"))
    assert tasks <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(readers.LISTING) == before
    assert {(r.db_id, r.ddl.rstrip("\n")) for r in back.collect()} == expected


def test_folders_without_ddl_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    spark.range(300).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(spark_queries, "scratch_path", lambda spark, name: str(tmp_path / name))
    rejects = {r.db_id: r.reason for r in spark_queries.d6_schema_rejects(spark, str(tmp_path)).collect()}
    parts = {p.rsplit("/part-", 1)[1][:5] for p in glob.glob(str(tmp_path / "ddl-folders" / "*" / "part-*.json"))}
    assert len(parts) > 4
    assert rejects == {f"shop {k}": "missing schema" if k % 5 == 2 else "not UTF-8" for k in range(300) if k % 5 == 2 or k % 7 == 3}


def tree(path):
    found = {}
    for at, _, names in os.walk(path):
        for name in names:
            if name.startswith("part-"):
                with open(os.path.join(at, name), "rb") as file:
                    found.setdefault(os.path.basename(at), []).extend(file.read().splitlines())
    return {folder: sorted(lines) for folder, lines in found.items()}


def test_files_of_databases_are_those_that_spark_writes_without_a_process_a_file(spark, tmp_path):
    names = ["a b", "a+b", "50%", "x/y", "q=1:2", "[é]^{}", "\t'\"#*?\\", "\x7f", "", None, "__x", "twice", "twice"]
    rows = spark.createDataFrame([(n, f"CREATE TABLE t{i} (é int);") for i, n in enumerate(names)], "db_id string, ddl string")
    rows = rows.unionByName(spark.createDataFrame([("none", None)], "db_id string, ddl string"))
    mine, theirs = str(tmp_path / "mine dir%20"), str(tmp_path / "theirs")
    writers.write_ddl_corpus(rows, mine)
    rows.where("ddl IS NOT NULL").write.partitionBy("db_id").text(theirs)
    assert tree(mine) == tree(theirs)
    assert os.path.exists(os.path.join(mine, "_SUCCESS"))
    hidden = [n for at, _, found in os.walk(mine) for n in found if n.startswith(".") and "_SUCCESS" not in n]
    assert not hidden  # Hadoop's local file system leaves a checksum file, made by a process of its own, beside each file


def test_modes_of_files_of_databases_are_those_of_spark(spark, tmp_path):
    path = "file://" + str(tmp_path / "ddl")
    one, two = (spark.createDataFrame([(f"d{i}", f"t{i}")], "db_id string, ddl string") for i in (1, 2))
    writers.write_ddl_corpus(one, path)
    with pytest.raises(AnalysisException):
        writers.write_ddl_corpus(two, path)
    writers.write_ddl_corpus(two, path, "ignore")
    assert set(tree(str(tmp_path / "ddl"))) == {"db_id=d1"}
    writers.write_ddl_corpus(two, path, "append")
    assert set(tree(str(tmp_path / "ddl"))) == {"db_id=d1", "db_id=d2"}
    writers.write_ddl_corpus(two, path, "overwrite")
    assert set(tree(str(tmp_path / "ddl"))) == {"db_id=d2"}
