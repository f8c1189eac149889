"""JSON array files read by many tasks.

An array has no line ends to split at, so a file is read as *fragments* that end at each ``}``. Whether a
fragment begins inside a string, and at which depth, depends on all text before it. Its effect is small,
though: the parity of its quotes, and one change of depth for either beginning. Effects are composed

1. within a block (a task's byte range of a file) by running sums over the fragments in their order, for both
   ways the block may begin;
2. over the blocks of a file by running sums over one row per block;
3. and each fragment learns how its block really begins. A record is what lies between two returns to depth 1.

Records of one fragment, the usual kind, are not shuffled; only the fragments of records with inner objects, or with
braces in their texts, meet again by their number.

Defined cases: a file is an array of objects or it is broken and gives no row; so are files with text behind the
array, with elements that are no objects, with bytes that are no UTF-8, or cut off. An empty array gives no row.
A file of zero bytes is not listed by Spark, so it counts as missing. Texts and records have no length limit;
a record must fit into a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlcorpus.functions.text import explode_present
from sqlcorpus.operators.skew import join_wide
from sqlcorpus.session import stage
from sqlcorpus.sources.jsontext import is_valid_json

END = "}"
#: JSON's white space; other blanks between values are errors.
BLANK = r"[ \t\r\n]*"
SCANNED = "file string, block_start bigint, fragment string, parity int, change_outside int, change_inside int, place bigint, inside int, depth_outside bigint, depth_inside bigint"


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Fragments with their effects; the ``}`` that ends a fragment is part of its change of depth."""
    text = spark.read.option("lineSep", END).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"), F.col("value").alias("fragment"))
    # backslashes occur in strings only, so escapes can be taken out before the state is known
    bare = text.withColumn("bare", F.regexp_replace("fragment", r"(?s)\\.", ""))
    parity = F.pmod(_count(F.col("bare"), '"'), F.lit(2))

    def change(begin: str, ends_outside: Column) -> Column:
        outside = F.regexp_replace(F.concat(F.lit(begin), "bare"), r'"[^"]*("|\z)', "")
        return _count(outside, "{[") - _count(outside, "}]") - ends_outside.cast("int")

    return bare.select(
        "file", "block_start", "fragment", parity.cast("int").alias("parity"),
        change("", parity == 0).alias("change_outside"), change('"', parity == 1).alias("change_inside"))


def _before(values: np.ndarray, start: int) -> np.ndarray:
    """Running sums of what lies before each value."""
    return start + np.concatenate(([0], np.cumsum(values)[:-1]))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each fragment its place in the block and, for a block that begins outside a string, whether the
    fragment begins ``inside`` one; and its depth for both beginnings of the block. A task's fragments come in order."""
    block, place, inside, depths = None, 0, 0, [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = batch.column("block_start").to_numpy(zero_copy_only=False)
        files = batch.column("file").dictionary_encode()
        codes = files.indices.to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((np.diff(starts) != 0) | (np.diff(codes) != 0)) + 1
        for low, high in zip([0, *edges], [*edges, batch.num_rows]):
            part = batch.slice(low, high - low)
            here = (files.dictionary[int(codes[low])].as_py(), int(starts[low]))
            if here != block:
                block, place, inside, depths = here, 0, 0, [0, 0]
            parity, outer, inner = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("parity", "change_outside", "change_inside"))
            begins = _before(parity, inside) % 2
            columns = [np.arange(place, place + len(parity), dtype=np.int64), begins.astype(np.int32)]
            for i, first in enumerate((begins, 1 - begins)):
                changes = np.where(first == 0, outer, inner)
                columns.append(_before(changes, depths[i]))
                depths[i] += int(changes.sum())
            place += len(parity)
            inside = int((inside + parity.sum()) % 2)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *map(pa.array, columns)], names=[*part.schema.names, "place", "inside", "depth_outside", "depth_inside"])


def _blocks(scanned: DataFrame) -> DataFrame:
    """One row per block: how it begins (``block_inside``, ``block_depth``) and the place of the file's last fragment."""
    last = F.struct(
        F.pmod(F.col("inside") + F.col("parity"), F.lit(2)).alias("parity"),
        (F.col("depth_outside") + F.when(F.col("inside") == 0, F.col("change_outside")).otherwise(F.col("change_inside"))).alias("outside"),
        (F.col("depth_inside") + F.when(F.col("inside") == 1, F.col("change_outside")).otherwise(F.col("change_inside"))).alias("inside"),
        F.col("place").alias("place"))
    totals = scanned.groupBy("file", "block_start").agg(F.max_by(last, "place").alias("t"))
    before = Window.partitionBy("file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    begun = totals.withColumn("block_inside", F.pmod(F.coalesce(F.sum("t.parity").over(before), F.lit(0)), F.lit(2)))
    change = F.when(F.col("block_inside") == 0, F.col("t.outside")).otherwise(F.col("t.inside"))
    first = F.row_number().over(Window.partitionBy("file").orderBy("block_start")) == 1
    last_of_file = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block_start"))) == 1
    return begun.select(
        F.struct("file", "block_start").alias("block"), F.col("file").alias("of_file"), "block_inside",
        F.coalesce(F.sum(change).over(before), F.lit(0)).alias("block_depth"),
        first.alias("first_block"), F.when(last_of_file, F.col("t.place")).alias("last_place"))


def _placed(scanned: DataFrame) -> DataFrame:
    """Fragments with their true state: ``starts`` a record (or the file), ``ends`` one, is the ``tail`` of the file."""
    known = join_wide(
        scanned.withColumn("block", F.struct("file", "block_start")), stage(_blocks(scanned), "array-blocks"), "block", "place", ["of_file"])
    in_string = F.pmod(F.col("inside") + F.col("block_inside"), F.lit(2)).alias("in_string")
    depth = F.col("block_depth") + F.when(F.col("block_inside") == 0, F.col("depth_outside")).otherwise(F.col("depth_inside"))
    first = F.col("first_block") & (F.col("place") == 0)
    placed = known.select("file", "block_start", "place", "fragment", "parity", "change_outside", "change_inside", in_string,
                          depth.alias("depth"), first.alias("first"), F.coalesce(F.col("place") == F.col("last_place"), F.lit(False)).alias("tail"))
    after = F.col("depth") + F.when(F.col("in_string") == 0, F.col("change_outside")).otherwise(F.col("change_inside"))
    starts = F.col("first") | ((F.col("in_string") == 0) & (F.col("depth") == 1))
    ends = (F.pmod(F.col("in_string") + F.col("parity"), F.lit(2)) == 0) & (after == 1)
    return placed.select("file", "block_start", "place", "fragment", "first", "tail", starts.alias("starts"), ends.alias("ends"))


def _joined(pieces: DataFrame) -> DataFrame:
    """Records of several fragments. Their number counts the starts before them: in the block, and in earlier blocks."""
    order = Window.partitionBy("file", "block_start").orderBy("place")
    counted = pieces.withColumn("n", F.sum(F.col("starts").cast("long")).over(order))
    blocks = pieces.groupBy("file", "block_start").agg(F.sum(F.col("starts").cast("long")).alias("n"))
    before = Window.partitionBy("file").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block_start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = counted.join(offsets, ["file", "block_start"]).withColumn("record", F.col("n") + F.col("offset"))
    parts = F.sort_array(F.collect_list(F.struct("block_start", "place", "fragment")))
    whole = numbered.groupBy("file", "record").agg(parts.alias("parts"), F.max("first").alias("first"), F.max("ends").alias("ends"))
    return whole.select("file", F.array_join(F.transform("parts", lambda p: p["fragment"]), END).alias("fragment"), "first", "ends")


def array_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, record, error)``: the text of every object in the array files, and an ``error`` (and no record) for
    everything that does not belong to an array of objects. Other rows have neither."""
    scanned = stage(_fragments(spark, path).mapInArrow(_running, SCANNED), "array-fragments")
    placed = _placed(scanned)
    whole = F.col("starts") & F.col("ends")
    several = _joined(placed.where(~F.col("tail") & ~whole).drop("tail"))
    # conditions stay within the expressions: a filter could be moved behind the error that a strict reader raises
    form = F.when(F.col("first"), F.lit(rf"^{BLANK}\[{BLANK}\]{BLANK}\z")).otherwise(F.lit(rf"^{BLANK}\]{BLANK}\z"))
    tail_fits = F.col("starts") & F.regexp_like("fragment", form)
    invalid = F.lit("invalid JSON")
    judged = placed.withColumns({"object": _object(), "good": _is_good()})
    single = judged.select(
        "file", F.when(~F.col("tail") & whole & F.col("good"), F.col("object")).alias("record"),
        F.when(F.col("tail"), F.when(~tail_fits, invalid)).when(whole & ~F.col("good"), invalid).alias("error"))
    joined = several.withColumns({"object": _object(), "good": _is_good()}).select(
        "file", F.when(F.col("good"), F.col("object")).alias("record"), F.when(~F.col("good"), invalid).alias("error"))
    return single.unionByName(joined)


def _object() -> Column:
    """The text of a record's object, without what stands between it and the one before."""
    return F.regexp_replace(F.concat("fragment", F.lit(END)), rf"^{BLANK}[,\[]{BLANK}", "")


def _is_good() -> Column:
    begin = F.when(F.col("first"), F.lit(rf"^{BLANK}\[{BLANK}\{{")).otherwise(F.lit(rf"^{BLANK},{BLANK}\{{"))
    text = F.concat("fragment", F.lit(END))
    return F.col("ends") & F.is_valid_utf8("fragment") & F.regexp_like(text, begin) & is_valid_json(_object())


def read_arrays(spark: SparkSession, path: str | list[str], schema: T.StructType, options: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the good array files with their ``file``, and ``(file, reason)`` for every broken one."""
    records = array_records(spark, path)
    rejects = stage(records.where("error IS NOT NULL").groupBy("file").agg(F.min("error").alias("reason")), "array-rejects")
    rows = records.where("record IS NOT NULL").select("file", F.from_json("record", schema, options).alias("r"), F.xxhash64("record").alias("spread"))
    good = join_wide(rows, rejects, "file", "spread", ["file"]).where("reason IS NULL")
    return good.select("r.*", "file"), rejects


def read_strict_arrays(spark: SparkSession, path: str | list[str], schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """Rows of the array files; a broken file fails the job that reads it."""
    checked = F.when(F.col("error").isNull(), F.col("record")).otherwise(F.raise_error(F.concat(F.col("error"), F.lit(" in "), F.col("file"))))
    return explode_present(array_records(spark, path), [], F.array(F.from_json(checked, schema, options)), "r").select("r.*")
