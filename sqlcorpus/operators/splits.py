"""Exact stratified splits, leak check and drift check.

Rows are ordered by ``md5(seed|id)``, so membership does not depend on partitioning. The cut is found
by radix selection over hash prefixes; only ids that share the last prefix are ever ranked, and
the full rows are labelled in one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlcorpus import fixed_values as fv
from sqlcorpus.session import stage

PREFIX_DIGITS = 3
HASH_DIGITS = 32
#: Rows of the bucket of a cut that one task may rank.
RANKED_BOUND = 1_000_000
MAX_BROADCAST_STRATA = 10_000


def hash_order(id_col: str, seed: int = fv.SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))


def split_cuts(
    rows: DataFrame, stratum: str, id_col: str, ratio: float, seed: int, digits: int, few_strata: bool,
    ranked_bound: int = RANKED_BOUND,
) -> DataFrame:
    """Per stratum the last ``(hash, id)`` that goes to A.

    Radix selection: a histogram of the first ``digits`` of the hash finds the bucket in which the cut of a stratum falls;
    while a bucket holds more than ``ranked_bound`` rows, a histogram of the next digits inside it narrows it. The
    ids of what is left are counted and ranked, so one task ranks at most ``ranked_bound`` of them whatever the
    size of a stratum, and an id repeated in many rows is one entry. Only the stratum and the id are read; each round writes
    one row per stratum, and the driver reads one number of it.
    """
    hashed = rows.select(F.col(stratum).alias("_stratum"), F.col(id_col).alias("_id"), hash_order(id_col, seed).alias("_h"))
    per_stratum = Window.partitionBy("_stratum")

    def narrowed(bucketed: DataFrame, length: int, cut: Column) -> DataFrame:
        """The bucket of ``length`` digits in which the cut lies: ``take`` rows of it go to A, of ``rows``."""
        histogram = bucketed.groupBy("_stratum", "_goal", F.substring("_h", 1, length).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
        # at most 16^digits rows per stratum reach these windows, however many examples there are
        running = histogram.select(
            "_stratum", "_bucket", "_n",
            F.sum("_n").over(per_stratum.orderBy("_bucket")).alias("_upto"),
            cut.alias("_cut"),
        )
        before = F.col("_upto") - F.col("_n")
        crossing = running.where((F.col("_upto") > F.col("_cut")) & (before <= F.col("_cut")))
        return crossing.select(F.col("_stratum").alias("_s"), F.col("_bucket").alias("_prefix"), (F.col("_cut") - before).alias("_take"), F.col("_n").alias("_rows"))

    def inside(crossing: DataFrame, length: int) -> DataFrame:
        known = F.broadcast(crossing) if few_strata else crossing
        return hashed.join(known, F.col("_stratum").eqNullSafe(F.col("_s")) & (F.substring("_h", 1, length) == F.col("_prefix")))

    length = digits
    share = F.floor(F.sum("_n").over(per_stratum) * F.lit(ratio))
    crossing = stage(narrowed(hashed.withColumn("_goal", F.lit(0)), length, share), "split-buckets")
    while length < HASH_DIGITS and (crossing.agg(F.max("_rows")).first()[0] or 0) > ranked_bound:
        bucketed = inside(crossing, length).withColumn("_goal", F.col("_take"))
        length = min(length + digits, HASH_DIGITS)
        crossing = stage(narrowed(bucketed, length, F.col("_goal")), "split-buckets")

    counted = inside(crossing, length).groupBy("_stratum", "_take", "_prefix", "_h", "_id").agg(F.count(F.lit(1)).alias("_copies"))
    upto = F.sum("_copies").over(per_stratum.orderBy("_h", "_id"))
    ranked = counted.select("_stratum", "_take", "_prefix", "_h", "_id", upto.alias("_upto"), "_copies")
    # nothing of the bucket taken: the bare prefix sorts before every hash in it
    wanted = F.greatest(F.col("_take"), F.lit(1))
    first = ranked.where((F.col("_upto") >= wanted) & (F.col("_upto") - F.col("_copies") < wanted))
    taken = F.col("_take") > 0
    return first.select(
        F.col("_stratum").alias("_s"),
        F.when(taken, F.col("_h")).otherwise(F.col("_prefix")).alias("_cut_h"),
        F.when(taken, F.col("_id")).alias("_cut_id"),
    )


def stratified_split(
    rows: DataFrame,
    stratum: str,
    id_col: str = "id",
    ratio: float = fv.SPLIT_RATIO,
    seed: int = fv.SEED,
    names: tuple[str, str] = ("validation", "test"),
    digits: int = PREFIX_DIGITS,
    strata_bound: int | None = None,
    durable_cuts: bool = False,
    ranked_bound: int = RANKED_BOUND,
) -> DataFrame:
    """Add ``split``: in every stratum the first ``floor(n * ratio)`` rows in hash order go to A.

    ``strata_bound`` states a known bound on the number of strata (5 for complexity labels). Without
    it the strata are counted, and the table of cuts is broadcast only when they are few.
    ``durable_cuts`` writes the cuts (one row per stratum) to the shared folder, so that results used by
    several jobs find them once.
    """
    if strata_bound is None:
        strata_bound = rows.select(stratum).distinct().limit(MAX_BROADCAST_STRATA + 1).count()
    few = strata_bound <= MAX_BROADCAST_STRATA
    cuts = split_cuts(rows, stratum, id_col, ratio, seed, digits, few, ranked_bound)
    if durable_cuts:
        cuts = stage(cuts, "cuts")
    if few:
        cuts = F.broadcast(cuts)
    in_first, placed = place(rows, stratum, id_col, seed, cuts)
    return placed.select(*rows.columns, F.when(in_first, names[0]).otherwise(names[1]).alias("split"))


def place(rows: DataFrame, stratum: str, id_col: str, seed: int, cuts: DataFrame) -> tuple[Column, DataFrame]:
    """Join the cuts and tell whether a row lies before the cut of its stratum."""
    h = hash_order(id_col, seed)
    placed = rows.join(cuts, F.col(stratum).eqNullSafe(F.col("_s")), "left")
    in_first = (
        F.col("_cut_h").isNull()  # no cut inside the stratum: the ratio takes all of it
        | (h < F.col("_cut_h"))
        | ((h == F.col("_cut_h")) & F.coalesce(F.col(id_col) <= F.col("_cut_id"), F.lit(False)))
    )
    return in_first, placed


def split_statistics(examples: DataFrame) -> DataFrame:
    """Rows and distinct databases per split, counted from (split, db_id) pre-aggregates."""
    pairs = examples.groupBy("split", "db_id").agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy("split").agg(F.sum("_n").alias("n_rows"), F.count("db_id").alias("n_databases"))


def class_counts(examples: DataFrame, label_col: str = "label") -> DataFrame:
    return examples.groupBy("split", F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def manifest(examples: DataFrame, seed: int = fv.SEED, label_col: str = "label") -> DataFrame:
    """Long manifest ``(split, metric, value)`` with counts, databases, classes and the seed; one pass."""
    labels = [*fv.CLASS_LABELS.values(), fv.UNKNOWN_LABEL]
    per_db = examples.groupBy("split", "db_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(label_col) == name).alias(name) for name in labels]
    )
    per_split = per_db.groupBy("split").agg(
        F.sum("n").alias("n_rows"),
        F.count("db_id").alias("n_databases"),
        *[F.nullif(F.sum(name), F.lit(0)).alias(f"class:{name}") for name in labels],
        F.lit(seed).cast("long").alias("seed"),
    )
    metrics = [name for name in per_split.columns if name != "split"]
    return per_split.unpivot(["split"], [F.col(f"`{m}`") for m in metrics], "metric", "value").where("value IS NOT NULL")


def overlaps(
    examples: DataFrame, keys: list[str], splits: tuple[str, ...], by_digest: bool = False
) -> DataFrame:
    """Distinct keys shared by each pair of splits, in one shuffle.

    Duplicates of a key collapse to one row before the shuffle, so a heavily copied key costs nothing.
    A fourth split adds its keys shared with the second and third, null where it has no rows. ``by_digest`` shuffles SHA-256 digests of length-prefixed keys, for long texts.
    """
    group = [F.col(k) for k in keys]
    if by_digest:
        parts = [F.coalesce(F.concat(F.length(k).cast("string"), F.lit(":"), k), F.lit("-")) for k in group]
        group = [F.sha2(F.concat(*parts), 256).alias("digest")]
    present = examples.groupBy(*group).agg(
        *[F.bool_or(F.col("split") == name).alias(f"in_{i}") for i, name in enumerate(splits)]
    )
    a, b, c, *further = (F.col(f"in_{i}") for i in range(len(splits)))
    other = [
        F.when(F.count_if(d) > 0, F.count_if(x & d)).alias(name)
        for d in further for x, name in ((b, "other_val_overlap"), (c, "other_test_overlap"))
    ]
    return present.agg(
        F.count_if(a & b).alias("train_val_overlap"),
        F.count_if(a & c).alias("train_test_overlap"),
        F.count_if(b & c).alias("val_test_overlap"),
        *other,
    )


def drift(counts: DataFrame, first: str = "validation", second: str = "test") -> DataFrame:
    """Largest difference of class shares in percentage points; an absent class has share 0."""
    n = F.col("n")
    by_label = counts.where(F.col("split").isin(first, second)).groupBy("label").agg(
        F.sum(F.when(F.col("split") == first, n).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("split") == second, n).otherwise(0)).alias("b"),
    )
    # one row per class label: the window covers a handful of rows
    everything = Window.partitionBy(F.lit(1))
    shares = by_label.select(
        F.coalesce(F.try_divide(F.col("a"), F.sum("a").over(everything)), F.lit(0.0)).alias("sa"),
        F.coalesce(F.try_divide(F.col("b"), F.sum("b").over(everything)), F.lit(0.0)).alias("sb"),
    )
    return shares.agg(F.coalesce(F.max(F.abs(F.col("sa") * 100 - F.col("sb") * 100)), F.lit(0.0)).alias("max_diff"))


def split_gate(overlap: DataFrame, drifted: DataFrame, limit: float = fv.MAX_DRIFT_POINTS) -> DataFrame:
    """Two one-row reports to check rows: shared keys between val and test or drift are errors; a null count is no row."""
    names = ["val_test_overlap", "train_val_overlap", "train_test_overlap"]
    names += [c for c in overlap.columns if c.startswith("other_")]
    counts = overlap.unpivot([], names, "check_name", "n").where("n IS NOT NULL")
    is_error = F.col("check_name") == names[0]
    leak = counts.select(
        "check_name",
        (~is_error | (F.col("n") == 0)).alias("passed"),
        F.concat(F.col("n").cast("string"), F.when(is_error, " shared").otherwise(" shared (warning)")).alias("message"),
    )
    shift = drifted.select(
        F.lit("distribution").alias("check_name"),
        (F.col("max_diff") <= limit).alias("passed"),
        F.concat(F.round("max_diff", 1).cast("string"), F.lit(" points")).alias("message"),
    )
    return leak.unionByName(shift)


def gate_in_one_pass(
    examples: DataFrame, keys: list[str], splits: tuple[str, ...], labels: list[str], limit: float = fv.MAX_DRIFT_POINTS
) -> DataFrame:
    """The rows of ``split_gate`` from one scan and one shuffle of the examples.

    ``splits`` names train, validation, test and the split of further sources. While copies of a key collapse for
    the leak check, the classes of their validation and test rows are counted beside it; labels that are not
    among ``labels`` count as one more class.
    """
    train, validation, test, other = splits
    place = F.col("split")
    named = F.coalesce(F.col("label").isin(*labels), F.lit(False))
    classes = [(F.col("label") == name) & named for name in labels] + [~named]
    tallies = {f"n_{side}_{i}": F.count_if((place == split) & label)
               for side, split in (("a", validation), ("b", test)) for i, label in enumerate(classes)}
    marks = [F.bool_or(place == name).alias(f"in_{i}") for i, name in enumerate(splits)]
    collapsed = examples.groupBy(*keys).agg(*marks, *[c.alias(n) for n, c in tallies.items()])
    t, v, e, o = (F.col(f"in_{i}") for i in range(4))
    shared = {
        "val_test_overlap": F.count_if(v & e), "train_val_overlap": F.count_if(t & v), "train_test_overlap": F.count_if(t & e),
        "other_val_overlap": F.when(F.count_if(o) > 0, F.count_if(v & o)),
        "other_test_overlap": F.when(F.count_if(o) > 0, F.count_if(e & o)),
    }
    facts = collapsed.agg(*[c.alias(n) for n, c in shared.items()], *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in tallies])

    def points(side: str, i: int) -> Column:
        total = sum((F.col(f"n_{side}_{j}") for j in range(len(classes))), F.lit(0))
        return F.coalesce(F.try_divide(F.col(f"n_{side}_{i}"), total), F.lit(0.0)) * 100

    apart = F.greatest(*[F.abs(points("a", i) - points("b", i)) for i in range(len(classes))])

    def row(name: str, passed: Column, message: Column) -> Column:
        return F.struct(F.lit(name).alias("check_name"), passed.alias("passed"), message.alias("message"))

    rows = []
    for name in shared:
        n, is_error = F.col(name), name == "val_test_overlap"
        message = F.concat(n.cast("string"), F.lit(" shared" if is_error else " shared (warning)"))
        rows.append(F.when(n.isNotNull(), row(name, n == 0 if is_error else F.lit(True), message)))
    rows.append(row("distribution", F.col("max_diff") <= limit, F.concat(F.round("max_diff", 1).cast("string"), F.lit(" points"))))
    report = facts.withColumn("max_diff", apart)
    return report.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*")


def is_valid(gate: DataFrame) -> DataFrame:
    return gate.agg(F.bool_and("passed").alias("valid"))
