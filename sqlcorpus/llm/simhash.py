"""SimHash near-duplicate groups by a segment-popcount embedding and a grid range join.

A fingerprint's 64 bits are 32 segments of two bits; the embedding is the bit count of each segment.
The Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints, so every
link within ``MAX_BITS`` differing bits lies within that Manhattan distance. Of the two halves of an
embedding at least one is then within ``MAX_BITS // 2``: each distinct fingerprint lies in one grid cell
per half and probes the cells around it, pairs beyond the Manhattan bound are dropped, and the exact bit
count of the XOR decides. Equal fingerprints meet before the join, once, whatever their number.

Only links are joined, and they end in components of distinct fingerprints: every round each fingerprint
joins its smallest neighbour and edges are contracted, which at least halves the fingerprints that still
have edges. Nothing but a count reaches the driver.

Defined cases: null and white-space-only texts have no words and the fingerprint zero, which links like
any other; fewer than ``SHINGLE`` words are one shingle; rows that repeat a ``doc_id`` are rows of their
own; null ids are carried, and a component's id is the smallest that is not null; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlcorpus.llm.common import attach, released
from sqlcorpus.session import stage

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Shingles of a text that are hashed and counted at once.
_BLOCK = 1 << 16
_LOW = 0x5555555555555555


def fingerprints(shingle: int = SHINGLE, seed: int = SEED):
    """A pandas UDF from texts to 64-bit fingerprints (as signed integers)."""

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        import xxhash

        digest = xxhash.xxh64_intdigest

        def one(text):
            words = [] if text is None else text.encode("utf-8", "replace").lower().split()
            if not words:
                return 0
            if len(words) <= shingle:
                shingles = [b" ".join(words)]
            else:
                spaced = [w + b" " for w in words]
                shingles = map(b"".join, zip(*[spaced[i:] for i in range(shingle - 1)], words[shingle - 1 :]))
            hashes = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8")
            counts = np.zeros(64, dtype=np.int64)
            for i in range(0, len(hashes), _BLOCK):
                block = hashes[i : i + _BLOCK]
                counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])

        for texts in batches:
            yield pd.Series([one(None if pd.isna(t) else t) for t in texts], dtype="int64")

    return F.pandas_udf(released(of), "long")


def unary(fp: Column) -> Column:
    """The embedding, each count 0, 1 or 2 of a segment written as 00, 01 or 11: the Hamming distance of
    two such words is the Manhattan distance of the counts."""
    upper = F.shiftrightunsigned(fp, 1)
    both, some = fp.bitwiseAND(upper).bitwiseAND(F.lit(_LOW)), fp.bitwiseOR(upper).bitwiseAND(F.lit(_LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _around(half: Column, steps: int) -> Column:
    """Cells within ``steps`` of a half embedding: in each step one of its 16 counts moves by one or none."""
    cells = F.array(half)
    for _ in range(steps):
        # 00 -> 01 and 01 -> 11 set the lowest clear bit of a segment, 11 -> 01 and 01 -> 00 clear its highest set bit
        moves = lambda c: F.flatten(F.array(*[_segment_moves(c, 2 * i) for i in range(16)]))
        cells = F.array_distinct(F.concat(cells, F.flatten(F.transform(cells, moves))))
    return cells


def _segment_moves(cell: Column, at: int) -> Column:
    low, high = 1 << at, 2 << at
    has_low, has_high = cell.bitwiseAND(F.lit(low)) != 0, cell.bitwiseAND(F.lit(high)) != 0
    flip = lambda bit: F.array(cell.bitwiseXOR(F.lit(bit)))
    return (
        F.when(~has_low, flip(low)).when(has_high, flip(high))
        .otherwise(F.array(cell.bitwiseXOR(F.lit(low)), cell.bitwiseXOR(F.lit(high))))
    )


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``a < b`` of the distinct fingerprints ``fp`` that differ in at most ``max_bits`` bits."""
    embedded = fps.select("fp", unary(F.col("fp")).alias("u"))
    halves = F.array(*[
        F.struct(F.lit(h).alias("half"), F.shiftrightunsigned("u", 32 * h).bitwiseAND(F.lit(0xFFFFFFFF)).alias("cell")) for h in (0, 1)
    ])
    homes = embedded.select(F.col("fp").alias("b"), F.col("u").alias("ub"), F.inline(halves))
    probes = (
        embedded.select(F.col("fp").alias("a"), F.col("u").alias("ua"), F.inline(halves))
        .select("a", "ua", "half", F.explode(_around(F.col("cell"), max_bits // 2)).alias("cell"))
    )
    manhattan = F.bit_count(F.col("ua").bitwiseXOR(F.col("ub")))
    hamming = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = probes.join(homes, ["half", "cell"]).where((F.col("a") < F.col("b")) & (manhattan <= max_bits) & (hamming <= max_bits))
    return pairs.select("a", "b").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every ``node``: the smallest node that edges ``(a, b)`` reach.

    A round joins every node with its smallest neighbour (then once more along the way), renames the ends
    of the edges, and drops those within a node; each round is staged, so lineage stays short.
    """
    label = nodes.select("node", F.col("node").alias("root"))
    edges = stage(edges.select("a", "b"), "edges")
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up"))
        near = stage(near, "nearest")
        nearest = near.select(F.col("a").alias("up"), F.col("up").alias("further"))
        step = stage(near.join(nearest, "up").select("a", F.col("further").alias("up")), "step")
        moved = attach(
            label, step.join(label.groupBy(F.col("root").alias("a")).agg(F.count("*").alias("_n")), "a").select(F.col("a").alias("root"), "up", "_n"),
            ["root"], "_n")
        label = stage(moved.select("node", F.coalesce("up", "root").alias("root")), "labels")
        ends = edges.join(step, "a").select(F.col("up").alias("x"), "b").join(step.select(F.col("a").alias("b"), "up"), "b")
        edges = stage(
            ends.select(F.least("x", "up").alias("a"), F.greatest("x", "up").alias("b")).where("a <> b").distinct(), "edges")
    return label


def _groups(rows: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, root, component_id)`` for every distinct ``fp`` of the staged ``rows(_id, fp)``, with its least id and rows.

    Only ``root`` tells components apart: several may share a ``component_id``, as ids may repeat or be null.
    """
    distinct = stage(rows.groupBy("fp").agg(F.min("_id").alias("_min"), F.count(F.lit(1)).alias("_rows")), "fingerprints")
    roots = components(distinct.select(F.col("fp").alias("node")), links(distinct.select("fp"), max_bits))
    rooted = roots.withColumnRenamed("node", "fp").join(distinct, "fp")
    first = rooted.groupBy("root").agg(F.min("_min").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    return stage(attach(rooted, first, ["root"], "_n").select("fp", "root", "component_id", "_min", "_rows"), "groups")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint, component_id``."""
    rows = stage(docs.select(F.col(id_col).alias("_id"), fingerprints(shingle)(F.col(text_col)).alias("fp")), "simhash")
    return attach(rows, _groups(rows, max_bits), ["fp"], "_rows").select(
        F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id; columns stay as they are.

    Rows get their number and fingerprint once and are staged with them; groups are found on numbers alone,
    and texts meet the numbers of the rows to keep in one shuffle, spread evenly.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_name, text_name = (names[docs.columns.index(c)] for c in (id_col, text_col))
    inner = docs.toDF(*names)
    inner = stage(inner.select("*", F.monotonically_increasing_id().alias("_row"), fingerprints(shingle)(F.col(text_name)).alias("_fp")), "simhash")
    rows = inner.select("_row", F.col(id_name).alias("_id"), F.col("_fp").alias("fp"))
    first = _groups(rows, max_bits).where(F.col("_min").eqNullSafe(F.col("component_id")))
    # several fingerprints of a component may carry its smallest id: the smallest fingerprint stays
    keep = first.groupBy("root").agg(F.min("fp").alias("fp"), F.min("component_id").alias("_keep"), F.max("_rows").alias("_rows"))
    numbers = (
        attach(rows, keep.select("fp", "_keep", "_rows", F.lit(True).alias("_found")), ["fp"], "_rows").where(F.col("_found") & F.col("_id").eqNullSafe(F.col("_keep")))
        .groupBy("fp", "_id").agg(F.min("_row").alias("_row")))
    return inner.join(numbers.select("_row"), "_row", "left_semi").select(*names).toDF(*docs.columns)
