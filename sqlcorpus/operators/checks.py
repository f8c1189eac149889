"""Ingest checks and the check roll-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlcorpus import fixed_values as fv
from sqlcorpus.functions.text import count_literal, explode_present, has


def missing_fields(present_keys: Column, required: list[str] | None = None) -> Column:
    """Required names absent from an array of keys; a key with a null value counts as present."""
    required = required or fv.REQUIRED_FIELDS
    return F.array_except(F.array(*[F.lit(name) for name in required]), present_keys)


def with_missing_fields(raw: DataFrame, json_col: str, required: list[str] | None = None) -> DataFrame:
    """Add ``missing``: the required fields a JSON object row does not have."""
    keys = F.coalesce(F.json_object_keys(F.col(json_col)), F.array().cast("array<string>"))
    return raw.withColumn("missing", missing_fields(keys, required))


def field_check(checked: DataFrame) -> DataFrame:
    """One row: counts and status of the required-field check."""
    total = F.count(F.lit(1))
    valid = F.count_if("ok")
    return checked.select((F.size("missing") == 0).alias("ok")).agg(total.alias("total"), valid.alias("valid")).select(
        "total",
        "valid",
        (F.col("total") - F.col("valid")).alias("invalid"),
        F.when(F.col("valid") == F.col("total"), "all valid")
        .when(F.col("valid") > 0, "some valid")
        .otherwise("none valid")
        .alias("status"),
    )


def first_offenders(checked: DataFrame, order_col: str, n: int = 3) -> DataFrame:
    """The first ``n`` rows with missing fields (a report, so the limit is the feature)."""
    return (
        checked.where(F.size("missing") > 0)
        .select(order_col, F.array_join("missing", ",").alias("missing"))
        .orderBy(order_col)
        .limit(n)
    )


def _keyword_hits(upper: Column, keyword: str, mode: str) -> Column:
    found = upper.contains(keyword)
    if mode == "word":  # the pattern runs only on rows that hold the letters at all
        found = found & has(upper, rf"\b{keyword}\b", flags="")
    hits = found.cast("long")
    if keyword == "SUBQUERY":
        hits = hits + (count_literal(upper, "SELECT") > 1).cast("long")
    return hits


def keyword_frequency(examples: DataFrame, sql_col: str = "query", mode: str = "substring") -> DataFrame:
    """Rows per keyword in one pass: one wide aggregate, then turned into rows."""
    upper = examples.select(F.upper(F.coalesce(F.col(sql_col), F.lit(""))).alias("u"))
    sums = [
        F.coalesce(F.sum(_keyword_hits(F.col("u"), word, mode)), F.lit(0)).alias(word) for word in fv.SQL_KEYWORDS
    ]
    wide = upper.agg(F.count(F.lit(1)).alias("total_rows"), *sums)
    return wide.unpivot(["total_rows"], fv.SQL_KEYWORDS, "keyword", "n").where("n > 0")


def top_keywords(frequency: DataFrame, n: int = 15) -> DataFrame:
    """Most common keywords with their share of all rows; ties in keyword order."""
    return (
        frequency.orderBy(F.desc("n"), "keyword")
        .limit(n)
        .select("keyword", "n", F.round(F.col("n") / F.col("total_rows") * 100, 1).alias("pct"))
    )


def database_coverage(files: DataFrame, minimum: int = fv.MIN_DATABASES) -> DataFrame:
    """From ``(db_id, path)``: directories, those with a database file, pass flag."""
    per_dir = files.groupBy("db_id").agg(F.bool_or(F.col("path").endswith(".sqlite")).alias("has_sqlite"))
    return per_dir.agg(
        F.count(F.lit(1)).alias("total_dbs"), F.count_if("has_sqlite").alias("dbs_with_sqlite")
    ).withColumn("passed", F.col("dbs_with_sqlite") >= minimum)


def databases_without_file(files: DataFrame, n: int = 5) -> DataFrame:
    per_dir = files.groupBy("db_id").agg(F.bool_or(F.col("path").endswith(".sqlite")).alias("has_sqlite"))
    return per_dir.where(~F.col("has_sqlite")).select("db_id").orderBy("db_id").limit(n)


def manifest_check(expected: DataFrame, observed: DataFrame, decimals: int = 1) -> DataFrame:
    """``expected(name)`` against ``observed(name, size_bytes, examples)``, one row per expected file."""
    return expected.join(observed, "name", "left").select(
        "name",
        F.col("size_bytes").isNotNull().alias("present"),
        F.round(F.coalesce(F.col("size_bytes"), F.lit(0)) / (1024 * 1024), decimals).alias("size_mb"),
        F.coalesce(F.col("examples"), F.lit(0)).alias("examples"),
    )


def required_files(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """The short list of expected file names."""
    return spark.createDataFrame([(name,) for name in names or fv.REQUIRED_FILES], "name string")


def all_present(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.bool_and("present").alias("all_present"), F.count_if(~F.col("present")).alias("n_missing"))


def check_row(df: DataFrame, name: str, passed: Column, message: Column) -> DataFrame:
    """Turn a one-row report into one row of the check table."""
    return df.select(
        F.lit(name).alias("check_name"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        F.coalesce(message, F.lit("")).alias("message"),
    )


def roll_up(checks: list[DataFrame]) -> DataFrame:
    """All check rows plus the closing ``all_passed`` row, from one evaluation of the checks."""
    table = reduce(DataFrame.unionByName, checks).withColumn("ok", F.col("passed"))
    row = ("check_name", "passed", "message")
    grouped = table.groupingSets([row, ()], *row).agg(
        F.grouping("check_name").alias("total"), F.bool_and("ok").alias("all_ok"), F.count_if(~F.col("ok")).alias("n_failed")
    )
    is_total = F.col("total") == 1
    return grouped.select(
        F.when(is_total, "all_passed").otherwise(F.col("check_name")).alias("check_name"),
        F.when(is_total, F.coalesce("all_ok", F.lit(True))).otherwise(F.col("passed")).alias("passed"),
        F.when(is_total, F.concat(F.col("n_failed").cast("string"), F.lit(" failed"))).otherwise(F.col("message")).alias("message"),
        is_total.alias("is_total"),
    )


def violations(rows: DataFrame, id_cols: list[str], rules: dict[str, Column]) -> DataFrame:
    """Rule table: one row per (row, broken rule)."""
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    return explode_present(rows, id_cols, broken, "violation")
