"""Joining a large, skewed table to one wide row per key.

The wide side is broadcast only after its bytes were measured. Beyond the bound the join is a
shuffle in which hot keys are split: the rows of a hot key are spread over salts and its wide row is
repeated once per salt. No row is dropped on either path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
ROWS_PER_SALT = 1_000_000
NULL_KEY_SALTS = 10_000


def measured_bytes(df: DataFrame, text_cols: list[str]) -> int:
    """Bytes of the text columns plus a row overhead, as one aggregate over the small side."""
    size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in text_cols), F.lit(64))
    return df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]


def hot_keys(large: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``(key, salts)`` of keys with more than ``rows_per_salt`` rows.

    At most ``rows / rows_per_salt`` keys can qualify, so this table is small by construction
    (100,000 entries for 100 billion rows).
    """
    counts = large.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where((F.col("_n") > rows_per_salt) & F.col(key).isNotNull()).select(
        key, F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_salts")
    )


def salted_left_join(
    large: DataFrame, wide: DataFrame, key: str, spread_by: str, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """Left join on ``key`` in which no task gets much more than ``rows_per_salt`` rows of one key.

    Rows without a key match nothing, so they are spread freely.
    """
    hot = F.broadcast(hot_keys(large, key, rows_per_salt))
    salts = F.when(F.col(key).isNull(), F.lit(NULL_KEY_SALTS)).otherwise(F.coalesce(F.col("_salts"), F.lit(1)))
    salt = F.pmod(F.xxhash64(F.col(spread_by)), salts.cast("long"))
    spread = large.join(hot, key, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    repeated = (
        wide.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return spread.join(repeated, [key, "_salt"], "left").drop("_salt")


def join_wide(
    large: DataFrame,
    wide: DataFrame,
    key: str,
    spread_by: str,
    text_cols: list[str],
    broadcast_bytes: int = BROADCAST_BYTES,
    size_bytes: int | None = None,
) -> DataFrame:
    """Left join with the strategy chosen from the measured size of the wide side.

    ``size_bytes`` passes a bound that was measured before, so that a computed side is not run twice.
    """
    if size_bytes is None:
        size_bytes = measured_bytes(wide, text_cols)
    if size_bytes <= broadcast_bytes:
        return large.join(F.broadcast(wide), key, "left")
    return salted_left_join(large, wide, key, spread_by)
