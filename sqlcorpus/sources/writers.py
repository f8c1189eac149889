"""Writers."""

from __future__ import annotations

import os
import re
import sys
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlcorpus.operators.examples import chat_rows
from sqlcorpus.operators.schemas import schema_index

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have the package


def write_jsonl(df: DataFrame, path: str, *partition_by: str, keep_nulls: bool = False, mode: str = "error") -> None:
    """JSON lines in UTF-8; ``keep_nulls`` writes null keys instead of leaving them out."""
    writer = df.write.mode(mode).option("ignoreNullFields", not keep_nulls)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)


def write_chat(chat: DataFrame, path: str, mode: str = "error") -> None:
    """Chat rows per split (columns ``split, system, user, assistant``) as JSON lines."""
    write_jsonl(chat_rows(chat, "split"), path, "split", mode=mode)


def file_per_database(rows: DataFrame) -> DataFrame:
    """Rows dealt out for a write with a folder per ``db_id``.

    The number of tasks is stated: adaptive execution would join small texts into one task, which then
    opens all files one after the other.
    """
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "db_id")


#: Characters that Spark escapes in the name of a partition's folder.
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
_NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as a folder of the local (or mounted) file system; None for any other file system."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        return os.path.abspath(path) if default.startswith("file:") else None
    return re.sub("^file:(//)?(?=/)", "", path) if path.startswith("file:/") else None


def _folder_of(db_id: str | None) -> str:
    """The folder of a database, named as Spark names the folder of a partition."""
    return "db_id=" + (_ESCAPED.sub(lambda c: f"%{ord(c[0]):02X}", db_id) if db_id else _NO_VALUE)


def _file_writer(folder: str, suffix: str):
    """Writes the rows ``(db_id, line)`` of a task, sorted by ``db_id``, as a file a database.

    A file gets its name when it is complete, and the name is that of the partition: an attempt that
    failed leaves only hidden files, and a repeated one replaces the files by the same ones.
    """
    run = uuid.uuid4().hex

    def write(batches) -> Iterator:
        from pyspark import TaskContext

        task = TaskContext.get()
        name, hidden = f"part-{task.partitionId():05d}-{run}{suffix}", f".{task.taskAttemptId()}-{run}{suffix}"
        at, out = None, None

        def close():
            if out is not None:
                out.close()
                os.replace(os.path.join(at, hidden), os.path.join(at, name))

        for batch in batches:
            for db_id, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = os.path.join(folder, _folder_of(db_id))
                if target != at:
                    close()
                    os.makedirs(target, exist_ok=True)
                    at, out = target, open(os.path.join(target, hidden), "wb")
                out.write(line + b"\n")
        close()
        yield from ()

    return write


def write_file_per_database(rows: DataFrame, path: str, mode: str = "error", fmt: str = "text") -> None:
    """``rows``, a ``db_id`` and one more column, as text or JSON lines in a directory a database (``db_id=...``).

    Hadoop's local file system starts two processes for every file it makes, to set modes, which takes
    most of the time of a write of many small files. There the tasks write the files themselves; other
    file systems are written by Spark. Modes and the ``_SUCCESS`` marker are Spark's in both cases.
    """
    spark = rows.sparkSession
    dealt = file_per_database(rows)
    folder = _local_folder(spark, path)
    if folder is None:
        dealt.write.mode(mode).partitionBy("db_id").format(fmt).save(path)
        return
    if mode == "ignore" and os.path.exists(folder):
        return
    nothing, mark = rows.limit(0), "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    nothing.write.mode(mode).partitionBy("db_id").option(mark, "false").format(fmt).save(path)
    value = next(c for c in rows.columns if c != "db_id")
    line = F.col(value) if fmt == "text" else F.to_json(F.struct(value))
    named = dealt.select(F.make_valid_utf8(F.col("db_id").cast("string")).alias("db_id"), line.cast("binary").alias("line"))
    write = _file_writer(folder, {"text": ".txt", "json": ".json"}[fmt])
    named.sortWithinPartitions("db_id").mapInArrow(write, "written int").write.format("noop").mode("overwrite").save()
    nothing.write.mode("append").partitionBy("db_id").format(fmt).save(path)


def write_ddl_corpus(schemas: DataFrame, path: str, mode: str = "error") -> None:
    """One text file per database directory (``db_id=...``), the layout ``read_ddl_corpus`` reads."""
    write_file_per_database(schemas.select("db_id", "ddl").where("ddl IS NOT NULL"), path, mode)


def write_schema_index(schemas: DataFrame, path: str, mode: str = "error") -> None:
    """The index with the DDL text as a column, as Parquet. Every row is made from its own DDL: nothing is shuffled."""
    schema_index(schemas, "ddl").withColumn(
        "parsed_timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    ).write.mode(mode).parquet(path)


def write_report(report: DataFrame, path: str, mode: str = "error") -> None:
    """A long metric table as one small JSON file. Reports have a bounded number of rows.

    The finished rows are shuffled into one task: merging partitions would compute the report in it.
    """
    report.repartition(1).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_demo_catalogue(catalogue: DataFrame, path: str, mode: str = "error") -> None:
    """Catalogue rows as JSON lines with their questions."""
    write_jsonl(catalogue, path, mode=mode)
