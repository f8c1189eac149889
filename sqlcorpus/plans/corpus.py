"""The corpus run: raw examples and schemas to rewritten, classified and split examples plus reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlcorpus import fixed_values as fv
from sqlcorpus.functions.features import UPPER, class_label, split_class, with_upper
from sqlcorpus.operators import checks, examples as ex, rewrite, schemas as sch, splits, stats
from sqlcorpus.session import stage
from sqlcorpus.sources import writers

COMPLEXITY_LABELS = len(fv.CLASS_LABELS) + 1


def classified(usable: DataFrame, sql_col: str = "pg_sql") -> DataFrame:
    """Add the split class as ``label``."""
    upper = with_upper(usable, sql_col)
    return upper.withColumn("label", class_label(split_class(F.col(UPPER)))).drop(UPPER)


def final_splits(
    labelled: DataFrame, ratio: float = fv.SPLIT_RATIO, seed: int = fv.SEED, durable_cuts: bool = False,
    stage_labels: bool = False,
) -> DataFrame:
    """Train stays; dev is cut into validation and test, stratified by class; other sources are the split ``other``.

    The cuts come from the dev rows; then one pass labels the rows of all sources, so that none is lost.
    ``stage_labels`` writes the labels and ids of the dev rows first: where ``labelled`` is no stored table, the
    passes that find the cuts then compute no label again.
    """
    dev = labelled.where(F.col("source") == "dev").select("label", "id")
    if stage_labels:
        dev = stage(dev, "labels")
    cuts = splits.split_cuts(dev, "label", "id", ratio, seed, splits.PREFIX_DIGITS, few_strata=True)
    if durable_cuts:
        cuts = stage(cuts, "cuts")
    in_first, placed = splits.place(labelled, "label", "id", seed, F.broadcast(cuts))  # one row per class
    dev_split = F.when(in_first, "validation").otherwise("test")
    split = F.when(F.col("source") == "train", "train").when(F.col("source") == "dev", dev_split).otherwise("other")
    return placed.select(*labelled.columns, split.alias("split"))


def prepared(examples: DataFrame, schemas: DataFrame) -> DataFrame:
    """Usable examples with cleaned and rewritten query and class label."""
    return classified(rewrite.rewrite_queries(ex.usable(examples, schemas)))


SPLITS = ("train", "validation", "test")


def gate(split_examples: DataFrame, sql_col: str = "pg_sql") -> DataFrame:
    """Leak and drift checks of finished splits as check rows, from one scan of them."""
    labels = [*fv.CLASS_LABELS.values(), fv.UNKNOWN_LABEL]
    return splits.gate_in_one_pass(split_examples, ["question", sql_col], (*SPLITS, "other"), labels)


@dataclass
class CorpusRun:
    """Result tables of one run; all of them are lazy except the two staged ones."""

    examples: DataFrame
    schemas: DataFrame
    conversion: DataFrame
    accounting: DataFrame
    manifest: DataFrame
    statistics: DataFrame
    checks: DataFrame
    rejects: DataFrame

    def write(self, path: str) -> None:
        """Chat JSON lines per split, the schema index, and one JSON file per report."""
        chat = ex.chat_columns(
            ex.attach_schema(self.examples, self.schemas, "pg_ddl"), "pg_ddl", "pg_sql"
        )
        writers.write_chat(chat.select("split", "system", "user", "assistant"), f"{path}/chat")
        writers.write_schema_index(self.schemas, f"{path}/schema_index")
        for name in ("conversion", "accounting", "manifest", "statistics", "checks", "rejects"):
            writers.write_report(getattr(self, name), f"{path}/{name}")


def reject_rows(schemas: DataFrame, source_errors: DataFrame | None = None) -> DataFrame:
    """``(kind, name, reason)`` of what the run could not use: databases without readable DDL and source files."""
    databases = sch.schema_rejects(schemas if "error" in schemas.columns else schemas.withColumn("error", F.lit(None).cast("string")))
    rows = databases.select(F.lit("schema").alias("kind"), F.col("db_id").alias("name"), "reason")
    if source_errors is None:
        return rows
    return rows.unionByName(source_errors.select(F.lit("source").alias("kind"), F.col("source").alias("name"), F.col("error").alias("reason")))


def run(examples: DataFrame, schemas: DataFrame, source_errors: DataFrame | None = None) -> CorpusRun:
    """Prepare once, stage the two shared results as Parquet, and describe them.

    The text is written once. The split is a small table of cuts applied on read, and the passes that
    find the cuts read only labels and ids of the staged rows. The staged schemas tell by ``has_ddl`` which
    databases are known, so that statuses and counts read no schema text. ``schemas`` may be the outcomes of
    ``ddl_outcomes`` and ``source_errors`` the table of that name: both end in the reject rows.
    """
    pg = stage(rewrite.rewrite_schemas(schemas).withColumn("has_ddl", F.col("ddl").isNotNull()), "schemas")
    done = final_splits(stage(prepared(examples, pg), "examples"), durable_cuts=True)
    overlap_and_drift = gate(done)
    residue = rewrite.residue_report(done, pg, "pg_sql", "pg_ddl")
    clean = residue.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    checks_table = checks.roll_up(
        [
            overlap_and_drift,
            checks.check_row(clean, "residue", F.col("n") == 0, F.concat(F.col("n").cast("string"), F.lit(" issues"))),
        ]
    )
    report = done.withColumn("sql", F.col("pg_sql"))
    return CorpusRun(
        examples=done,
        schemas=pg,
        conversion=ex.conversion_counts(examples, pg),
        accounting=rewrite.rewrite_accounting(done.drop("pg_sql"), pg.drop("pg_ddl")),
        manifest=splits.manifest(done),
        statistics=stats.full_report(report, pg, "pg_ddl", SPLITS),
        checks=checks_table,
        rejects=reject_rows(pg, source_errors),
    )
