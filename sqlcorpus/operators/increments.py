"""Leak checks and database counts over a corpus that grows by batches.

Of every batch, one theta sketch a split is stored: a sample of key hashes below a threshold, at most
``2 ** LG_ENTRIES`` of them. Sketches of batches merge to the sketch of all rows, so a new batch reads the sketches of
the earlier ones and not their rows. Overlaps come as an estimate with an upper bound; pairs of splits whose bound is
above the tolerance are counted exactly, reading the keys of those splits alone.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sketch of at most 16,384 hashes, 128 KB: up to so many distinct keys it counts exactly, beyond within 0.8 % (one sigma).
LG_ENTRIES = 14
#: Width of the bound in standard deviations.
SIGMAS = 3.0
SKETCHES = "split string, name string, sketch binary"


def key_digest(keys: list[str]) -> Column:
    """SHA-256 of the keys, each with its length before it; a null differs from an empty text."""
    parts = [F.coalesce(F.concat(F.length(k).cast("string"), F.lit(":"), k), F.lit("-")) for k in keys]
    return F.sha2(F.concat(*parts), 256)


def batch_sketches(batch: DataFrame, named_keys: dict[str, list[str]], lg_entries: int = LG_ENTRIES) -> DataFrame:
    """``(split, name, sketch)`` of one batch, in one scan with partial aggregation.

    ``named_keys`` gives a name to each list of key columns. Rows whose keys are all null are no key.
    """
    def digest(keys: list[str]) -> Column:
        return F.when(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull(), key_digest(keys))

    wide = batch.select("split", *[digest(keys).alias(name) for name, keys in named_keys.items()])
    per_split = wide.groupBy("split").agg(*[F.theta_sketch_agg(name, lg_entries).alias(name) for name in named_keys])
    return per_split.unpivot(["split"], list(named_keys), "name", "sketch")


def add_batch(batch: DataFrame, batch_id: int, named_keys: dict[str, list[str]], path: str) -> None:
    """Store the sketches of one batch below ``path``; a batch that is added again replaces its own."""
    batch_sketches(batch, named_keys).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def merged(spark: SparkSession, path: str, lg_entries: int = LG_ENTRIES) -> DataFrame:
    """``(split, name, sketch, n)`` over all stored batches; ``n`` estimates the distinct keys."""
    stored = spark.read.schema(SKETCHES).parquet(f"{path}/batch=*")
    united = stored.groupBy("split", "name").agg(F.theta_union_agg("sketch", lg_entries).alias("sketch"))
    return united.withColumn("n", F.theta_sketch_estimate("sketch"))


def overlap_estimates(sketches: DataFrame, name: str, splits: tuple[str, ...], lg_entries: int = LG_ENTRIES) -> DataFrame:
    """``(first, second, estimate, upper)`` of each pair of splits from one row of merged sketches.

    A sketch keeps a key with probability ``entries / n``, at most 1, so the kept shared keys are binomial; ``upper``
    is where ``SIGMAS`` deviations below the mean still reach the kept number. It equals the estimate as long
    as both splits have fewer keys than a sketch has entries.
    """
    picked = sketches.where(F.col("name") == name).agg(
        *[F.max(F.when(F.col("split") == s, F.col("sketch"))).alias(f"s{i}") for i, s in enumerate(splits)],
        *[F.coalesce(F.max(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, s in enumerate(splits)],
    )
    rows = []
    for i, j in combinations(range(len(splits)), 2):
        common = F.coalesce(F.theta_sketch_estimate(F.theta_intersection(f"s{i}", f"s{j}")), F.lit(0)).cast("double")
        most = F.greatest(f"n{i}", f"n{j}").cast("double")
        rate = F.least(F.lit(1.0), F.lit(float(1 << lg_entries)) / F.greatest(most, F.lit(1.0)))
        kept, z2 = common * rate, SIGMAS * SIGMAS * (1 - rate)
        upper = (kept + z2 / 2 + F.sqrt(kept * z2 + z2 * z2 / 4)) / rate
        rows.append(F.struct(F.lit(splits[i]).alias("first"), F.lit(splits[j]).alias("second"), common.alias("estimate"), F.ceil(upper).alias("upper")))
    return picked.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def exact_overlap(rows: DataFrame, keys: list[str], first: str, second: str) -> int:
    """Distinct keys in both splits: one shuffle of digests, copies collapsed before it."""
    pair = rows.where(F.col("split").isin(first, second)).where(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull())
    present = pair.groupBy(key_digest(keys).alias("digest")).agg(
        F.bool_or(F.col("split") == first).alias("a"), F.bool_or(F.col("split") == second).alias("b"))
    return present.agg(F.count_if(F.col("a") & F.col("b"))).first()[0]


def overlaps(
    spark: SparkSession, path: str, name: str, keys: list[str], splits: tuple[str, ...],
    all_rows: Callable[[], DataFrame], tolerance: int = 0, lg_entries: int = LG_ENTRIES,
) -> DataFrame:
    """``(first, second, estimate, upper, exact)``: exact counts of the pairs whose bound is above ``tolerance``.

    ``all_rows`` gives the rows of all batches and is called only if a pair needs them. As long as each split has fewer
    keys than a sketch has entries, estimates are exact and no row is read; a corpus free of leaks is then
    checked by its sketches alone. ``exact`` is null where the bound is within ``tolerance``.
    """
    estimates = overlap_estimates(merged(spark, path, lg_entries), name, splits, lg_entries).collect()  # one row per pair of splits
    out, rows = [], None
    for e in estimates:
        exact = None
        if e["upper"] > tolerance:
            rows = all_rows() if rows is None else rows
            exact = exact_overlap(rows, keys, e["first"], e["second"])
        out.append((e["first"], e["second"], e["estimate"], e["upper"], exact))
    return spark.createDataFrame(out, "first string, second string, estimate double, upper long, exact long")
