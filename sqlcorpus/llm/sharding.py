"""Sharding by sampled splitters: shards of nearly equal bytes, equal texts side by side.

Records are ordered by the hash of their text, so copies are neighbours. A size-weighted sample of keys
gives quantile boundaries of many small ranges, the records are range-partitioned by them, and each
range's bytes and rows are counted over all records. A range that holds more than its share (a large
group of copies, or bad luck of the sample) is subdivided by splitters sampled inside it: by the same key
while it spans several texts, then by the hash of the id, then by the row. The ranges, largest first, are
dealt to the emptiest shard, so that shards differ by no more than the smallest pieces.

What reaches the driver is bounded by the number of ranges: about ``2 * RANGES`` a shard, or two per
``RANGE_ROWS`` rows where that is more, and ``SAMPLES`` keys for each. Sampling only chooses boundaries;
counts, slots and shards cover every record.

Defined cases: null and empty texts have no bytes besides the ``OVERHEAD``; rows that repeat id and text
are records of their own, told apart by their row; null ids are carried; one record is never cut, so a
record larger than a shard's share makes an uneven shard; an empty table gives an empty result; ``write``
keeps all columns, whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sqlcorpus.llm.common import free_name
from sqlcorpus.session import stage

SHARDS = 24
#: Bytes that a record counts besides its text.
OVERHEAD = 8
#: Full ranges that a shard would hold, most rows of a range, and sampled keys for each full range.
RANGES = 64
RANGE_ROWS = 1_000_000
SAMPLES = 16
#: Keys by which ranges are cut, in this order.
LEVELS = ("k0", "k1", "k2")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32`` and the keys of every row; the text itself stays behind."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    text = F.coalesce("_text", F.lit(""))
    return rows.select(
        "doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("k0"), F.xxhash64("doc_id").alias("k1"), F.col("_row").alias("k2"))


@dataclass
class Splitters:
    """Rounds of boundaries: the first cuts all records, each later one cuts ranges of the one before.

    A round is ``(level, {range: (boundaries, number of its first part)})``.
    """

    rounds: list[tuple[int, dict]] = field(default_factory=list)
    used: int = 1

    def cut(self, level: int, parts: dict[int, list[int]]) -> None:
        placed = {}
        for at, boundaries in parts.items():
            placed[at] = (boundaries, self.used)
            self.used += len(boundaries) + 1
        self.rounds.append((level, placed))

    def range_of(self, *keys: Column) -> Column:
        """The number of the range that a record's keys fall in."""
        rounds = self.rounds

        def of(k0: pd.Series, k1: pd.Series, k2: pd.Series) -> pd.Series:
            import numpy as np

            keys = [k.to_numpy(dtype="int64") for k in (k0, k1, k2)]
            at = np.zeros(len(keys[0]), dtype="int64")
            for level, parts in rounds:
                moved = at.copy()
                for x in np.unique(at):
                    if x in parts:
                        boundaries, first = parts[x]
                        rows = at == x
                        moved[rows] = first + np.searchsorted(np.asarray(boundaries, dtype="int64"), keys[level][rows], side="right")
                at = moved
            return pd.Series(at)

        return F.pandas_udf(of, "long")(*keys)


def _boundaries(sample: list[tuple[int, float]], greatest: int) -> list[int]:
    """Keys at every half range of the sample's weight, and the greatest key, so that a cut always parts rows.

    A key that weighs half a range itself, as that of a large group of copies, gets a range of its own.
    """
    weights: dict[int, float] = {}
    for key, weight in sample:
        weights[key] = weights.get(key, 0.0) + weight
    out, seen = {greatest}, 0.0
    for key, weight in sorted(weights.items()):
        if 2 * weight >= SAMPLES:
            out.update((key, key + 1) if key < greatest else (key,))
        elif int(2 * (seen + weight) / SAMPLES) > int(2 * seen / SAMPLES):
            out.add(key)
        seen += weight
    return sorted(out)


def choose(records: DataFrame, shards: int = SHARDS, ranges: int = RANGES, range_rows: int = RANGE_ROWS) -> tuple[Splitters, dict[int, tuple[int, int]]]:
    """Splitters for the staged ``records`` of ``sized``, and each range's bytes and rows."""
    splitters, stats = Splitters(), {}
    keys = [F.col(k) for k in LEVELS]
    measures = [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")]
    ends = [f(k).alias(f"{n}{k}") for k in LEVELS for n, f in (("lo", F.min), ("hi", F.max))]
    whole = records.agg(*measures, *ends).first()
    if not whole.rows:
        return splitters, stats
    limit = max(1, -(-whole.bytes // (shards * ranges)))
    found = {0: whole}
    while found:
        cuts: dict[int, dict[int, int]] = {}
        for at, r in found.items():
            level = next((i for i, k in enumerate(LEVELS) if r[f"lo{k}"] < r[f"hi{k}"]), None)
            if level is None or (r.bytes <= limit and r.rows <= range_rows):
                stats[at] = (r.bytes, r.rows)
            else:
                cuts.setdefault(level, {})[at] = r[f"hi{LEVELS[level]}"]
        if not cuts:
            break
        placed = records.withColumn("range", splitters.range_of(*keys))
        wanted = F.greatest(F.col("size") * F.lit(SAMPLES / limit), F.lit(SAMPLES / range_rows))
        chance = F.pmod(F.xxhash64(*keys, F.lit(len(splitters.rounds))), F.lit(1 << 30)) / F.lit(float(1 << 30))
        new: list[int] = []
        for level, wide in cuts.items():
            drawn = placed.where(F.col("range").isin(list(wide))).where(chance < wanted).select("range", LEVELS[level], F.greatest(wanted, F.lit(1.0)).alias("weight"))
            sample: dict[int, list] = {at: [] for at in wide}
            for r in drawn.collect():
                sample[r["range"]].append((r[LEVELS[level]], r["weight"]))
            before = splitters.used
            splitters.cut(level, {at: _boundaries(sample[at], wide[at]) for at in wide})
            new += range(before, splitters.used)
        placed = records.withColumn("range", splitters.range_of(*keys))
        found = {r["range"]: r for r in placed.where(F.col("range").isin(new)).groupBy("range").agg(*measures, *ends).collect()}
    return splitters, stats


def deal(stats: dict[int, tuple[int, int]], shards: int = SHARDS) -> dict[int, tuple[int, int]]:
    """Each range's shard and its first slot there: the largest range next, to the shard with the fewest bytes."""
    shard_bytes, filled, out = [(0, s) for s in range(shards)], [0] * shards, {}
    for at, (size, rows) in sorted(stats.items(), key=lambda x: (-x[1][0], x[0])):
        full, shard = heapq.heappop(shard_bytes)
        out[at] = (shard, filled[shard])
        filled[shard] += rows
        heapq.heappush(shard_bytes, (full + size, shard))
    return out


def _dealt(df: DataFrame, dealt: dict[int, tuple[int, int]]) -> DataFrame:
    """``df(range, ...)`` with ``shard`` and ``first``; one small row a range is broadcast."""
    where = df.sparkSession.createDataFrame([(at, s, n) for at, (s, n) in dealt.items()], "range bigint, shard int, first bigint")
    return df.join(F.broadcast(where), "range")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, ranges: int = RANGES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, size, text_crc32, shard, slot``; slots count from 0 in each shard.

    Slots are numbered inside ranges, which are bounded, and start where the shard's ranges before end.
    """
    records = stage(sized(docs, id_col, text_col), "shard-records")
    splitters, stats = choose(records, shards, ranges, range_rows)
    placed = _dealt(records.withColumn("range", splitters.range_of(*LEVELS)), deal(stats, shards))
    slot = F.col("first") + F.row_number().over(W.partitionBy("range").orderBy(*LEVELS)) - 1
    return placed.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> None:
    """Write ``docs`` as Parquet in folders ``shard=0`` and so on, one file for each of a shard's parts, copies side by side.

    The rows are staged once, as their place among equal rows must not change between two reads.
    """
    row = free_name(docs, "_row")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "shard-documents")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keys = [F.xxhash64(text), F.xxhash64(F.col(f"`{id_col}`")), F.col(row)]
    records = stage(
        rows.select((F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), *[k.alias(n) for k, n in zip(keys, LEVELS, strict=True)]), "shard-records")
    splitters, stats = choose(records, shards)
    at, part = free_name(docs, "shard"), free_name(docs, "_range")
    ranges = splitters.range_of(*keys)
    where = rows.sparkSession.createDataFrame([(r, s) for r, (s, _) in deal(stats, shards).items()], f"`{part}` bigint, `{at}` int")
    placed = rows.withColumn(part, ranges).join(F.broadcast(where), part)
    placed.repartition(max(1, len(stats) // 8), at, F.pmod(part, F.lit(8))).sortWithinPartitions(at, part, keys[0], row).drop(row, part).write.partitionBy(at).parquet(path)
