"""Small helpers shared by the operators."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with the most rows that are joined by a broadcast; every other key has at most 1/1000 of the rows.
HOT_KEYS = 1000
#: ASCII white space, the characters that separate words unless an operator says otherwise.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``facts``, which has one row per key; ``weight`` is the number of rows of a key.

    The HOT_KEYS heaviest keys meet their rows by a broadcast of exactly that many facts, so that their
    rows are not shuffled; no key of the shuffled rest holds more than 1/HOT_KEYS of the rows.
    """
    hot = facts.orderBy(F.desc(weight), *keys).limit(HOT_KEYS)
    heavy = rows.join(F.broadcast(hot), keys, "inner")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts, keys, how)
    return heavy.unionByName(rest)


def without_ascii_space(text: Column) -> Column:
    """The text with every character of ``[\\x20\\x09-\\x0D]`` deleted; null stays null."""
    for char in ASCII_SPACE:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other letter as it is."""
    for code in range(ord("A"), ord("Z") + 1):
        text = F.replace(text, F.lit(chr(code)), F.lit(chr(code + 32)))
    return text


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def unused(df: DataFrame, name: str) -> str:
    """``name``; an error if ``df`` has such a column, which a new one would hide."""
    if name != free_name(df, name):
        raise ValueError(f"there is a column {name}; give another name")
    return name


def released(work):
    """``work`` on a task's batches; what it held then goes back to the system.

    Python workers live on after a task, and allocators would keep the memory of the largest one for good.
    """

    @functools.wraps(work)
    def run(batches):
        import ctypes

        import pyarrow as pa

        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in the GNU library
        if trim:
            trim(0)

    return run


#: Bits of one bitmap of the SQL bitmap functions.
BLOCK_BITS = 32768


def bitmaps(positions: DataFrame, column: str) -> DataFrame:
    """Bitmaps ``(_block, _map)`` in which the positions (from 1) of ``column`` are set."""
    return positions.groupBy(F.bitmap_bucket_number(column).alias("_block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("_map"))


def probe(df: DataFrame, maps: DataFrame, positions: list[Column], name: str) -> DataFrame:
    """``df`` with a boolean ``name``: whether all ``positions`` are set in ``maps``, which are broadcast.

    The caller bounds the number of bits, and so the size of the broadcast.
    """
    out, hits = df, F.lit(True)
    for i, position in enumerate(positions):
        part = F.broadcast(maps.select(F.col("_block").alias(f"_b{i}"), F.col("_map").alias(f"_m{i}")))
        out = out.withColumn(f"_p{i}", position).join(part, F.bitmap_bucket_number(f"_p{i}") == F.col(f"_b{i}"), "left")
        at = F.bitmap_bit_position(f"_p{i}")
        byte = F.conv(F.hex(F.substring(F.col(f"_m{i}"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1))
        hits = hits & (F.coalesce(bit, F.lit(0)) == 1)
    return out.withColumn(name, hits).drop(*[f"_{c}{i}" for c in "bmp" for i in range(len(positions))])
