"""Readers. Every read states its schema; nothing is inferred and nothing reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlcorpus.functions.text import is_blank, strip
from sqlcorpus.sources.arrays import read_arrays, read_strict_arrays
from sqlcorpus.sources.jsontext import JSON_OPTIONS, is_valid_json

EXAMPLE = T.StructType(
    [
        T.StructField("db_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("question_toks", T.ArrayType(T.StringType())),
    ]
)
MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
CHAT = T.StructType([T.StructField("messages", T.ArrayType(MESSAGE))])
CATALOGUE = T.StructType(
    [
        T.StructField("db_id", T.StringType()),
        T.StructField("table_names_original", T.ArrayType(T.StringType())),
    ]
)
DEMO_ENTRY = "map<string,struct<schema_file:string,name:string,description:string,tables:array<string>,sample_questions:array<string>>>"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence on whatever file system the path names."""
    try:
        spark.read.format("binaryFile").load(path).select("path").limit(1).count()
        return True
    except Exception as error:  # AnalysisException; other kinds are real failures
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def _filled(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.na.fill("", [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)])


def read_example_array(spark: SparkSession, path: str | list[str], schema: T.StructType = EXAMPLE) -> DataFrame:
    """Example files that hold one JSON array each, large ones read by many tasks; absent fields become empty text.

    The files are cut into records at once; a broken file fails the job that reads the rows.
    """
    return _filled(read_strict_arrays(spark, path, schema, {"mode": "FAILFAST", **JSON_OPTIONS}), schema)


def read_example_files(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Example array files, and a reject row ``(file, reason)`` for every file that is no array of objects.

    A broken file gives no examples and stops nothing; the other files are read in full.
    """
    good, rejects = read_arrays(spark, path, EXAMPLE, JSON_OPTIONS)
    return good.na.fill("", ["db_id", "question", "query"]), rejects


def read_example_array_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """None for a missing file; a broken file fails when it is read."""
    return read_example_array(spark, path) if path_exists(spark, path) else None


def array_documents(documents: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """Rows of JSON array documents held in a text column."""
    items = F.from_json(F.col(text_col), T.ArrayType(EXAMPLE), {"mode": "FAILFAST", **JSON_OPTIONS})
    return documents.select(*keep, F.inline(items)).na.fill("", ["db_id", "question", "query"])


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str = CHAT) -> DataFrame:
    """Strict reader: a line that is not exactly one JSON value fails the job. Blank lines are skipped."""
    line = strip(F.col("value"))
    checked = F.when(is_valid_json(line), line).otherwise(F.raise_error(F.lit("not exactly one JSON value in a line")))
    lines = spark.read.text(path).where(~is_blank(F.col("value")))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST", **JSON_OPTIONS}).alias("r")).select("r.*")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines with their file and place, as ``(file, block_start, line_in_task, line)``."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_in_task"),
        F.col("value").alias("line"),
    )


def with_line_numbers(lines: DataFrame, wanted: Column) -> DataFrame:
    """Line numbers (from 1) of the wanted lines, exact across file splits.

    One row per file block gives its number of lines; running sums over the blocks of a file give the
    offset of each block.
    """
    blocks = lines.groupBy("file", "block_start").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_in_task").alias("first_in_task")
    )
    w = Window.partitionBy("file").orderBy("block_start")
    offsets = blocks.select("file", "block_start", "first_in_task", (F.sum("n").over(w) - F.col("n")).alias("offset"))
    return (
        lines.where(wanted)
        .join(offsets, ["file", "block_start"])
        .select(
            "file",
            (F.col("offset") + F.col("line_in_task") - F.col("first_in_task") + 1).alias("line_number"),
            "line",
        )
    )


def classify_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Add ``line_status``: ``ok``, ``blank`` or ``broken``."""
    line = F.col(line_col)
    status = F.when(is_blank(line), "blank").when(is_valid_json(strip(line)), "ok").otherwise("broken")
    return lines.withColumn("line_status", status)


def tolerant(
    lines: DataFrame, order_cols: list[str], line_col: str = "line", max_samples: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Good lines and the quarantine of broken ones.

    With ``max_samples`` only the lines up to the n-th good one count, as a reader that stops there:
    the good rows are a top-n by position, and later broken lines are not reported.
    """
    classified = classify_lines(lines, line_col)
    good = classified.where(F.col("line_status") == "ok").drop("line_status")
    broken = classified.where(F.col("line_status") == "broken").withColumn("reason", F.lit("invalid JSON"))
    broken = broken.drop("line_status")
    if not max_samples:
        return good, broken
    good = good.orderBy(*order_cols).limit(max_samples)
    # the one row holding the place of the last good line
    stop = good.groupBy(F.lit("invalid JSON").alias("reason")).agg(
        F.max(F.struct(*order_cols)).alias("stop"), (F.count(F.lit(1)) >= max_samples).alias("stopped")
    )
    before_stop = ~F.coalesce(F.col("stopped"), F.lit(False)) | (F.struct(*order_cols) < F.col("stop"))
    seen = broken.join(F.broadcast(stop), "reason", "left").where(before_stop)
    return good, seen.drop("stop", "stopped")


def read_jsonl_tolerant(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str = CHAT, max_samples: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Parsed good rows, and ``(file, line_number, line, reason)`` for every broken line."""
    place = ["file", "block_start", "line_in_task"]
    lines = read_lines(spark, path)
    good, broken = tolerant(lines, place, max_samples=max_samples)
    parsed = good.select(F.from_json(strip(F.col("line")), schema, JSON_OPTIONS).alias("r")).select("r.*")
    numbered = with_line_numbers(classify_lines(lines), F.col("line_status") == "broken")
    if max_samples:
        seen = broken.select("file", "block_start", "line_in_task").withColumn("seen", F.lit(True))
        marked = classify_lines(lines).join(seen, place, "left")
        numbered = with_line_numbers(marked, F.col("seen"))
    return parsed, numbered.withColumn("reason", F.lit("invalid JSON"))


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listing(spark: SparkSession) -> Iterator[None]:
    """Folders listed meanwhile are dealt to four tasks a core; Spark's default is one task a folder up to 10,000."""
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING, before)


def read_ddl_corpus(spark: SparkSession, root: str, file_name: str = "schema.sql") -> DataFrame:
    """``(db_id, ddl)``, one row per database, from the DDL files in database directories below ``root``.

    Of several directories of one database the last by path counts.
    """
    with listing(spark):
        files = (
            spark.read.option("recursiveFileLookup", True)
            .option("pathGlobFilter", file_name)
            .text(root, wholetext=True)
        )
    path = F.col("_metadata.file_path")
    named = files.select(_database_of(path).alias("db_id"), path.alias("path"), F.col("value").alias("ddl"))
    return named.groupBy("db_id").agg(F.max_by("ddl", "path").alias("ddl"))


def ddl_outcomes(spark: SparkSession, root: str, file_name: str = "schema.sql") -> DataFrame:
    """``(db_id, ddl, error)``, one row per database directory below ``root``, whatever became of its DDL.

    ``error`` is ``not UTF-8`` for a file whose bytes are no text (its ``ddl`` is null), and null otherwise;
    a directory without a DDL file has neither. Files of other names are listed and not read. Spark lists no
    files of zero bytes: such a DDL file counts as missing, and a directory of nothing else is not seen.
    """
    listed = list_files(spark, root).select("db_id").distinct()
    files = _binary_files(spark, root, file_name)
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    read = files.select(
        _database_of(F.col("_metadata.file_path")).alias("db_id"), "path",
        F.struct(F.when(valid, text).alias("ddl"), F.when(~valid, F.lit("not UTF-8")).alias("error")).alias("r"),
    )
    last = read.groupBy("db_id").agg(F.max_by("r", "path").alias("r"))
    return listed.join(last, "db_id", "left").select("db_id", "r.ddl", "r.error")


def _database_of(path: Column) -> Column:
    """The database named by a file's folder: percent escapes decoded, ``+`` as it is, without ``db_id=``."""
    folder = F.replace(F.element_at(F.split(path, "/"), -2), F.lit("+"), F.lit("%2B"))
    return F.regexp_replace(F.url_decode(folder), r"^db_id=", "")


def _binary_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    with listing(spark):
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(path, db_id, name, size_bytes)`` of files below ``root``; contents are never read."""
    parts = F.split("path", "/")
    return _binary_files(spark, root, glob).select(
        "path",
        _database_of(F.col("_metadata.file_path")).alias("db_id"),
        F.element_at(parts, -1).alias("name"),
        F.col("length").alias("size_bytes"),
    )


def ddl_corpus_gaps(spark: SparkSession, root: str, file_name: str = "schema.sql") -> DataFrame:
    """Database directories without a DDL file (only names and sizes are listed)."""
    files = list_files(spark, root)
    with_ddl = files.where(F.col("name") == file_name).select("db_id").distinct()
    return files.select("db_id").distinct().join(with_ddl, "db_id", "left_anti")


def line_counts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``(name, examples)``: lines per file."""
    lines = spark.read.text(paths)
    return (
        lines.groupBy(F.col("_metadata.file_path").alias("path"))
        .agg(F.count(F.lit(1)).alias("examples"))
        .select(F.element_at(F.split("path", "/"), -1).alias("name"), "examples")
    )


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue of table names per database: JSON array files, large ones read by many tasks."""
    return read_strict_arrays(spark, path, CATALOGUE, {"mode": "FAILFAST", **JSON_OPTIONS})


def read_demo_catalogue(spark: SparkSession, json_path: str, ddl_dir: str | None = None) -> DataFrame:
    """Demo catalogue: one JSON object keyed by schema name, optionally with its DDL files."""
    text = spark.read.text(json_path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", DEMO_ENTRY, JSON_OPTIONS)).alias("name", "e")).where(
        F.col("e.sample_questions").isNotNull()
    )
    flat = entries.select(
        "name", F.col("e.name").alias("title"), "e.description", "e.schema_file", "e.tables", "e.sample_questions",
        F.element_at(F.split("e.schema_file", "/"), -1).alias("file_name"),
    )
    if ddl_dir is None:
        return flat
    files = spark.read.option("pathGlobFilter", "*.sql").text(ddl_dir, wholetext=True)
    ddl = files.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"), F.col("value").alias("ddl")
    )
    return flat.join(ddl, "file_name", "left")
