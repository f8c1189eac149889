"""Corpus statistics per split.

Distributions come from value histograms: ``groupBy(split, metric, value).count()`` collapses on the
map side, and minimum, maximum, mean and the exact upper median all follow from the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlcorpus.fixed_values import CLASS_LABELS
from sqlcorpus.functions.features import UPPER, flag_columns, report_label, with_upper
from sqlcorpus.functions.text import token_count
from sqlcorpus.session import stage


def length_columns(parts: dict[str, Column]) -> dict[str, Column]:
    """Characters and white-space tokens of every text part."""
    out: dict[str, Column] = {}
    for name, text in parts.items():
        text = F.coalesce(text, F.lit(""))
        out[f"{name}_chars"] = F.length(text).cast("long")
        out[f"{name}_tokens"] = token_count(text).cast("long")
    return out


def distribution(lengths: DataFrame, group: str, metrics: list[str], weight: str | None = None) -> DataFrame:
    """``(group, metric, n, min, max, avg, median)`` with the upper median ``sorted[n // 2]``.

    ``weight`` names a column telling how many rows one row stands for, so lengths measured once per
    database count for every example of it.
    """
    amount = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    long_form = lengths.unpivot([group] + ([weight] if weight else []), metrics, "metric", "v")
    histogram = long_form.groupBy(group, "metric", "v").agg(amount.alias("c"))
    per_metric = Window.partitionBy(group, "metric")
    running = histogram.select(
        group, "metric", "v", "c",
        F.sum("c").over(per_metric.orderBy("v")).alias("upto"),
        F.sum("c").over(per_metric).alias("n"),
    )
    at_half = F.col("upto") > F.floor(F.col("n") / 2)
    return running.groupBy(group, "metric").agg(
        F.max("n").alias("n"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.round(F.sum(F.col("v") * F.col("c")) / F.max("n"), 1).alias("avg"),
        F.min(F.when(at_half, F.col("v"))).alias("median"),
    )


def zero_filled(stats: DataFrame, groups: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """An empty group reports zeros. ``groups`` is the short list of expected group names."""
    wanted = groups.select(group, F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    return wanted.join(stats, [group, "metric"], "left").na.fill(0)


#: Metrics of the text parts of an example.
TEXT_METRICS = [f"{part}_{unit}" for part in ("schema", "question", "sql") for unit in ("chars", "tokens")]


def with_expected(stats: DataFrame, group: str, expected: tuple[str, ...]) -> DataFrame:
    """Text statistics with zeros for the ``expected`` groups that have no rows; other groups stay."""
    if not expected:
        return stats
    groups = stats.sparkSession.createDataFrame([(name,) for name in expected], f"{group} string")
    others = stats.where(~F.col(group).isin(*expected))
    return zero_filled(stats.where(F.col(group).isin(*expected)), groups, group, TEXT_METRICS).select(*stats.columns).unionByName(others)


def feature_counts(examples: DataFrame, group: str = "split", sql_col: str = "sql") -> DataFrame:
    """``(group, feature, n, pct)`` for features that occur; one wide aggregate, then rows."""
    flags = flag_columns(F.col(UPPER))
    wide = with_upper(examples.select(group, sql_col), sql_col).groupBy(group).agg(
        F.count(F.lit(1)).alias("total_rows"), *[F.count_if(flag).alias(name) for name, flag in flags.items()]
    )
    long_form = wide.unpivot([group, "total_rows"], list(flags), "feature", "n").where("n > 0")
    return long_form.select(
        group, "feature", "n", F.round(F.col("n") / F.col("total_rows") * 100, 1).alias("pct")
    )


def report_classes(examples: DataFrame, group: str = "split", sql_col: str = "sql") -> DataFrame:
    """``(group, label, n, pct)`` of the report classes."""
    counts = (
        with_upper(examples.select(group, sql_col), sql_col)
        .groupBy(group, report_label(F.col(UPPER)).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(group))
    return counts.select(group, "label", "n", F.round(F.col("n") / total * 100, 1).alias("pct"))


def distinct_databases(examples: DataFrame, group: str = "split", approximate: bool = False) -> DataFrame:
    """Databases per split, exact through (group, db_id) pre-aggregates, or approximate on request."""
    if approximate:
        return examples.groupBy(group).agg(F.approx_count_distinct("db_id").alias("n_databases"))
    pairs = examples.where(F.col("db_id").isNotNull()).groupBy(group, "db_id").agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy(group).agg(F.count(F.lit(1)).alias("n_databases"))


def example_totals(examples: DataFrame, group: str = "split") -> DataFrame:
    """Rows per split plus the grand total (null group) from one scan."""
    counts = examples.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupingSets([(group,), ()], group).agg(F.sum("n").alias("n"))


TEXT_METRICS = ["schema_chars", "question_chars", "sql_chars", "schema_tokens", "question_tokens", "sql_tokens"]


def own_text_distribution(examples: DataFrame) -> DataFrame:
    """Distributions of the texts every example owns: question and query."""
    own = examples.select(
        "split",
        *[c.alias(n) for n, c in length_columns({"question": F.col("question"), "sql": F.col("sql")}).items()],
    )
    return distribution(own, "split", [m for m in TEXT_METRICS if not m.startswith("schema")])


def schema_text_distribution(per_db: DataFrame, schemas: DataFrame, ddl_col: str = "ddl") -> DataFrame:
    """Distributions of schema text, measured once per database and weighted by its examples.

    ``per_db(split, db_id, n)`` holds the number of examples.
    """
    measured = schemas.select(
        "db_id", *[c.alias(n) for n, c in length_columns({"schema": F.col(ddl_col)}).items()]
    )
    weighted = per_db.select("split", "db_id", "n").join(measured, "db_id", "left")
    return distribution(
        weighted.na.fill(0, ["schema_chars", "schema_tokens"]), "split", ["schema_chars", "schema_tokens"], weight="n"
    )


def text_distribution(examples: DataFrame, schemas: DataFrame, ddl_col: str = "ddl") -> DataFrame:
    """All six text distributions per split."""
    per_db = examples.groupBy("split", "db_id").agg(F.count(F.lit(1)).alias("n"))
    return own_text_distribution(examples).unionByName(schema_text_distribution(per_db, schemas, ddl_col))


def database_facts(examples: DataFrame, sql_col: str = "sql") -> DataFrame:
    """One row per (split, database): examples, features and classes, all from one pass.

    Every count of the report follows from this table, which is as long as there are databases.
    """
    upper = F.col(UPPER)
    flags = flag_columns(upper)
    label = report_label(upper)
    counted = with_upper(examples.select("split", "db_id", sql_col), sql_col).select(
        "split", "db_id", *[flag.alias(name) for name, flag in flags.items()], label.alias("_label")
    )
    return counted.groupBy("split", "db_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(name).alias(name) for name in flags],
        *[F.count_if(F.col("_label") == name).alias(f"class_{name}") for name in CLASS_LABELS.values()],
    )


def full_report(examples: DataFrame, schemas: DataFrame, ddl_col: str = "ddl", expected: tuple[str, ...] = ()) -> DataFrame:
    """Everything as long rows ``(split, section, name, stat, value)``; the total has a null split.

    An ``expected`` split without examples has text statistics of zeros.

    Two passes over the examples: one for ``database_facts``, staged because five sections read it, and
    one for the text histograms.
    """
    facts = stage(database_facts(examples), "database-facts")
    features = [name for name in facts.columns if name.startswith("has_")]
    classes = [f"class_{name}" for name in CLASS_LABELS.values()]

    def rows(df: DataFrame, section: str, name: Column, stats: list[str]) -> DataFrame:
        cast = df.select("split", name.alias("name"), *[F.col(s).cast("double").alias(s) for s in stats])
        return cast.unpivot(["split", "name"], stats, "stat", "value").select(
            "split", F.lit(section).alias("section"), "name", "stat", "value"
        )

    per_split = facts.groupBy("split").agg(
        F.sum("n").alias("total_rows"),
        F.count("db_id").alias("n_databases"),
        *[F.sum(name).alias(name) for name in features + classes],
    )

    def shares(columns: list[str]) -> DataFrame:
        long_form = per_split.unpivot(["split", "total_rows"], columns, "name", "n").where("n > 0")
        return long_form.withColumn("pct", F.round(F.col("n") / F.col("total_rows") * 100, 1))

    totals = facts.groupingSets([("split",), ()], "split").agg(F.sum("n").alias("n"))
    texts = with_expected(own_text_distribution(examples).unionByName(schema_text_distribution(facts, schemas, ddl_col)), "split", expected)
    return (
        rows(totals, "totals", F.lit("examples"), ["n"])
        .unionByName(rows(per_split, "totals", F.lit("databases"), ["n_databases"]))
        .unionByName(rows(shares(features), "sql_features", F.col("name"), ["n", "pct"]))
        .unionByName(rows(shares(classes), "complexity", F.regexp_replace("name", "^class_", ""), ["n", "pct"]))
        .unionByName(rows(texts, "token_stats", F.col("metric"), ["min", "max", "avg", "median"]))
    )


def report_json(report: DataFrame) -> DataFrame:
    """``full_report`` rows as one nested JSON text per split. A report has a few hundred rows."""
    stats_of = F.map_from_entries(F.collect_list(F.struct("stat", "value")))
    names_of = F.map_from_entries(F.collect_list(F.struct("name", "stats")))
    sections = F.map_from_entries(F.collect_list(F.struct("section", "names")))
    return (
        report.groupBy("split", "section", "name").agg(stats_of.alias("stats"))
        .groupBy("split", "section").agg(names_of.alias("names"))
        .groupBy("split").agg(F.to_json(sections).alias("report"))
    )
