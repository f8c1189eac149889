"""Scoring generated queries against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlcorpus import fixed_values as fv
from sqlcorpus.functions.sqltext import completion, normalise_query
from sqlcorpus.operators.splits import hash_order


def seeded_sample(rows: DataFrame, id_col: str = "id", k: int = fv.EVAL_SAMPLES, seed: int = fv.SEED) -> DataFrame:
    """``k`` rows by hash order (all rows when there are fewer): a top-k, never a full sort."""
    return rows.orderBy(hash_order(id_col, seed), id_col).limit(k)


def exact_match(generated: Column, reference: Column) -> Column:
    return normalise_query(generated) == normalise_query(reference)


def score(references: DataFrame, predictions: DataFrame, id_col: str = "id") -> DataFrame:
    """Join predictions to references. A missing generation counts as the empty answer."""
    joined = references.join(predictions.select(id_col, F.col("generated").alias("_raw")), id_col, "left")
    generated = F.coalesce(completion(F.col("_raw")), F.lit(""))
    return (
        joined.withColumn("generated", generated)
        .withColumn("exact_match", exact_match(F.col("generated"), F.col("reference")))
        .drop("_raw")
    )


def accuracy(scored: DataFrame, *groups: str) -> DataFrame:
    """Counts and accuracy, overall or per group; 0 when there is nothing to score."""
    total, matches = F.count(F.lit(1)), F.count_if("exact_match")
    return scored.groupBy(*groups).agg(
        total.alias("num_samples"),
        matches.alias("exact_matches"),
        F.coalesce(F.try_divide(matches, total), F.lit(0.0)).alias("exact_match_accuracy"),
    )


def preview(text: Column, length: int = fv.PROMPT_PREVIEW) -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def report_records(scored: DataFrame, order_col: str = "id", n: int = fv.REPORT_ROWS) -> DataFrame:
    """The first records for inspection, long prompts shortened."""
    return (
        scored.orderBy(order_col)
        .limit(n)
        .select(order_col, preview(F.col("prompt")).alias("prompt"), "reference", "generated", "exact_match")
    )


def evaluation(
    references: DataFrame,
    predictions: DataFrame,
    id_col: str = "id",
    k: int = fv.EVAL_SAMPLES,
    seed: int = fv.SEED,
) -> tuple[DataFrame, DataFrame]:
    """Sample, score and report: ``(one row of totals, the first records in sample order)``."""
    order = "_sample_order"
    sampled = seeded_sample(references, id_col, k, seed).withColumn(order, hash_order(id_col, seed))
    scored = score(sampled, predictions, id_col)
    return accuracy(scored), report_records(scored, order).drop(order)


def perplexity(losses: DataFrame, loss_col: str, *groups: str) -> DataFrame:
    """exp(mean loss); an overflowing exponent gives infinity."""
    return losses.groupBy(*groups).agg(F.exp(F.avg(loss_col)).alias("perplexity"))
