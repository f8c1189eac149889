"""A landing folder of JSON lines: rewrite each file as it arrives, keep broken lines apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sqlcorpus import fixed_values as fv
from sqlcorpus.functions.sqltext import last_content
from sqlcorpus.functions.text import strip
from sqlcorpus.operators.examples import chat_rows
from sqlcorpus.operators.rewrite import rewrite_chat
from sqlcorpus.sources.readers import CHAT, JSON_OPTIONS, classify_lines


def read_landing(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Stream of ``(file, line)``."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def split_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chat columns of good lines, and the broken lines. Works on batches and streams alike."""
    return split_classified(classify_lines(lines))


def split_classified(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for lines that ``classify_lines`` has marked."""
    good = marked.where(F.col("line_status") == "ok").select(
        "file", F.from_json(strip(F.col("line")), CHAT, JSON_OPTIONS)["messages"].alias("messages")
    )
    chat = good.select("file", *[last_content(F.col("messages"), role).alias(role) for role in fv.ROLES])
    broken = marked.where(F.col("line_status") == "broken").select("file", "line")
    return chat, broken


def start_rewrite(lines: DataFrame, out: str, quarantine: str, checkpoint: str) -> StreamingQuery:
    """Rewrite good lines to JSON lines and append broken ones to the quarantine.

    Each micro-batch has its own folder and overwrites it, so a batch repeated after a failure leaves
    the same files. Its lines are read and classified once and kept for both writes; what a lost executor
    kept is read again.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        marked = classify_lines(batch).persist()
        chat, broken = split_classified(marked)
        rewritten = rewrite_chat(chat).select(
            "system", F.col("new_user").alias("user"), F.col("new_assistant").alias("assistant")
        )
        chat_rows(rewritten).write.mode("overwrite").json(f"{out}/batch={batch_id}")
        broken.write.mode("overwrite").json(f"{quarantine}/batch={batch_id}")
        marked.unpersist()

    return (
        lines.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
