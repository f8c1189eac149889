"""Exact deduplication by a two-pass Bloom filter, in DataFrame functions only.

Pass 1 hashes every text to ``HASHES`` positions of a bit space and keeps the positions that were hit
more than once; they become a bitmap of bounded size. Pass 2 probes the bitmap: a text that misses one
of its positions is certainly unique and passes straight through. Only the rest, true copies and a few
false positives, is shuffled, where exact SHA-256 groups decide. A fuller bitmap sends more rows through
the shuffle but never changes a result.

Defined cases: null counts as empty text; empty texts are equal to each other; of equal texts the one
with the most code points stays, then the smallest ``doc_id`` (null ids last); of rows that agree in
these as well exactly one stays; an empty table gives an empty result; further columns are carried by
``deduplicate`` and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sqlcorpus.llm.common import BLOCK_BITS, attach, bitmaps, probe, without_ascii_space
from sqlcorpus.session import stage

HASHES = 2
#: Bits of the filter for each row, and the most bits it may have: 128 MB of bitmap, the bound of the broadcast.
BITS_PER_ROW = 16
MAX_BITS = 1 << 30


def fingerprint(text: Column) -> Column:
    """SHA-256 of the text without ASCII white space, as 32 bytes."""
    return F.unhex(F.sha2(F.encode(without_ascii_space(F.coalesce(text, F.lit(""))), "UTF-8"), 256))


def filter_bits(rows: int) -> int:
    return min(MAX_BITS, max(BLOCK_BITS, 1 << (max(1, rows) * BITS_PER_ROW - 1).bit_length()))


def _positions(sha: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(sha, F.lit(i)), F.lit(bits)) + 1 for i in range(HASHES)]


def repeated_positions(digests: DataFrame, bits: int) -> DataFrame:
    """Pass 1: bitmaps ``(_block, _map)`` of the positions that more than one row hit."""
    hit = digests.select(F.explode(F.array(*_positions(F.col("_sha"), bits))).alias("_p")).groupBy("_p").count()
    return bitmaps(hit.where("count > 1"), "_p")


def flag_possible_copies(df: DataFrame, maps: DataFrame, bits: int) -> DataFrame:
    """Pass 2: adds ``_maybe``, true where every position of ``_sha`` is set."""
    return probe(df, maps, _positions(F.col("_sha"), bits), "_maybe")


def _first(digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of possible copies: one row per (text, length, id) with its count, and one row per text with what stays."""
    same = digests.groupBy("_sha", "_chars", "_id").agg(F.count(F.lit(1)).alias("_same"))
    best = same.groupBy("_sha").agg(
        F.sum("_same").alias("_size"),
        F.max(F.struct(F.col("_chars"), F.bitwise_not("_id").alias("_back"), F.col("_id"))).alias("_best"),
    )
    return same, best.select("_sha", "_size", F.col("_best._chars").alias("_best_chars"), F.col("_best._id").alias("_best_id"))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("_id"),
        fingerprint(F.col(text_col)).alias("_sha"),
        F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("_chars"),
    )


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are read once: digests are staged and both passes and the groups work on them.
    """
    digests = stage(_digests(docs, id_col, text_col), "digests")
    bits = filter_bits(digests.count())
    flagged = stage(flag_possible_copies(digests, repeated_positions(digests, bits), bits), "possible-copies")
    same, best = _first(flagged.where("_maybe"))
    copies = attach(same, best, ["_sha"], "_size").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_same"))))
    stays = (F.col("_chars") == F.col("_best_chars")) & F.col("_id").eqNullSafe(F.col("_best_id")) & (F.col("_copy") == 1)
    sha = F.lower(F.hex("_sha")).alias("text_sha256")
    return (
        flagged.where("NOT _maybe")
        .select(F.col("_id").alias("doc_id"), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                F.lit(True).alias("kept"), sha)
        .unionByName(copies.select(
            F.col("_id").alias("doc_id"), F.col("_best_id").alias("keep_id"), F.col("_size").alias("group_size"),
            stays.alias("kept"), sha))
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; the columns and their names stay as they are.

    Possibly repeated rows meet the rows to keep on (text, length, id), so a group of copies spreads
    over the partitions; unique rows are not shuffled.
    """
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    digests = stage(_digests(inner, at[id_col], at[text_col]), "digests")
    bits = filter_bits(digests.count())
    maps = stage(repeated_positions(digests, bits), "bitmaps")
    _, best = _first(flag_possible_copies(digests, maps, bits).where("_maybe"))
    keys = inner.withColumns({
        "_id": F.col(at[id_col]),
        "_sha": fingerprint(F.col(at[text_col])),
        "_chars": F.coalesce(F.char_length(at[text_col]), F.lit(0)).cast("long"),
    })
    flagged = flag_possible_copies(keys, maps, bits)
    best = best.select(F.col("_sha").alias("_s"), F.col("_best_chars").alias("_n"), F.col("_best_id").alias("_k"))
    one = W.partitionBy("_sha", "_chars", "_id").orderBy(F.lit(1))
    copies = (
        flagged.where("_maybe")
        .join(best, (F.col("_sha") == F.col("_s")) & (F.col("_chars") == F.col("_n")) & F.col("_id").eqNullSafe(F.col("_k")), "left_semi")
        .withColumn("_row", F.row_number().over(one)).where("_row = 1")
    )
    names = inner.columns
    return flagged.where("NOT _maybe").select(*names).unionByName(copies.select(*names)).toDF(*docs.columns)
