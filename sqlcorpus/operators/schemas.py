"""Schema index: one row per database, its statistics and its comparison with a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlcorpus import fixed_values as fv
from sqlcorpus.functions import ddl as d
from sqlcorpus.functions.text import explode_present, find_all, has, regex, strip


def schema_tables(schemas: DataFrame) -> DataFrame:
    """Long form: ``(db_id, pos, table_name)``."""
    return explode_present(schemas, ["db_id"], d.table_names(F.col("ddl")), "pos", "table_name")


def schema_columns(schemas: DataFrame) -> DataFrame:
    """Long form: ``(db_id, table_name, pos, column_name)``."""
    per_table = explode_present(schemas, ["db_id"], d.table_columns(F.col("ddl")), "t")
    return explode_present(
        per_table, ["db_id", F.col("t.name").alias("table_name")], F.col("t.columns"), "pos", "column_name"
    )


def schema_foreign_keys(schemas: DataFrame, inline: bool = False) -> DataFrame:
    """Long form of FK edges with their source table (null outside a CREATE TABLE body).

    ``inline`` adds ``col type REFERENCES t(c)`` edges, which the index leaves out.
    """
    ddl = F.col("ddl")
    out = explode_present(schemas, ["db_id"], d.foreign_keys_by_table(ddl), "pos", "fk").select(
        "db_id", "pos", "fk.source_table", "fk.edge.column", "fk.edge.references_table", "fk.edge.references_column",
        F.lit("table").alias("kind"),
    )
    if not inline:
        return out
    blocks = explode_present(schemas, ["db_id"], d.table_blocks(ddl), "t")
    lines = blocks.select(
        "db_id", F.col("t.name").alias("source_table"), F.posexplode(F.split("t.body", "\n", -1)).alias("pos", "line")
    )
    line = F.col("line")
    refs = lines.where(~has(line, fv.HAS_FOREIGN_KEY)).select(
        "db_id", "pos", "source_table",
        F.regexp_extract(strip(line), regex(fv.COLUMN_HEAD), 1).alias("column"),
        F.get(find_all(line, fv.INLINE_REFERENCE, 1), F.lit(0)).alias("references_table"),
        F.get(find_all(line, fv.INLINE_REFERENCE, 2), F.lit(0)).alias("references_column"),
        F.lit("inline").alias("kind"),
    )
    return out.unionByName(refs.where(F.col("references_table").isNotNull()))


def has_ddl(schemas: DataFrame) -> Column:
    """Whether a database's DDL was found: the column ``has_ddl`` where a table keeps it, so that no text is read."""
    return F.col("has_ddl") if "has_ddl" in schemas.columns else F.col("ddl").isNotNull()


def schema_index(schemas: DataFrame, *keep: str) -> DataFrame:
    """One row per readable database; a null DDL (missing file) is excluded. ``keep`` names further columns."""
    ddl = F.col("ddl")
    return schemas.where(ddl.isNotNull()).select(
        "db_id",
        d.table_names(ddl).alias("tables"),
        d.table_columns(ddl).alias("table_columns"),
        d.foreign_keys(ddl).alias("foreign_keys"),
        d.has_foreign_keys(ddl).alias("has_foreign_keys"),
        d.has_primary_keys(ddl).alias("has_primary_keys"),
        d.has_pragma(ddl).alias("has_pragma"),
        F.length(ddl).cast("long").alias("content_length"),
        *keep,
    ).withColumn("num_tables", F.size("tables"))


def schema_rejects(outcomes: DataFrame) -> DataFrame:
    """``(db_id, reason)`` of databases that are not in the index: no DDL file, or one that is no text."""
    return outcomes.where(F.col("ddl").isNull()).select("db_id", F.coalesce("error", F.lit("missing schema")).alias("reason"))


def index_statistics(schemas: DataFrame) -> DataFrame:
    """One row of counters; only the table names and the FK flag are extracted for it.

    A column ``error`` tells unreadable files from missing ones, as ``ddl_outcomes`` gives it.
    """
    ddl = F.col("ddl")
    failed = F.col("error").isNotNull() if "error" in schemas.columns else F.lit(False)
    facts = schemas.select(
        ddl.isNotNull().alias("found"),
        failed.alias("failed"),
        F.size(d.table_names(ddl)).alias("n"),
        F.coalesce(d.has_foreign_keys(ddl), F.lit(False)).alias("fk"),
    )
    found = F.col("found")
    return facts.agg(
        F.count(F.lit(1)).alias("total_found"),
        F.count_if(found | F.col("failed")).alias("schema_files_found"),
        F.count_if(found).alias("successfully_parsed"),
        F.count_if(~found & ~F.col("failed")).alias("missing_schema"),
        F.count_if("failed").alias("parse_errors"),
        F.count_if(found & (F.col("n") < 5)).alias("databases_lt_5_tables"),
        F.count_if(found & F.col("n").between(5, 10)).alias("databases_5_to_10_tables"),
        F.count_if(found & (F.col("n") > 10)).alias("databases_gt_10_tables"),
        F.count_if(found & F.col("fk")).alias("databases_with_foreign_keys"),
    )


def cross_reference(schemas: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Full outer comparison of indexed table names with ``catalogue(db_id, table_names_original)``."""
    indexed = schemas.where(F.col("ddl").isNotNull()).select(
        "db_id", F.transform(d.table_names(F.col("ddl")), F.lower).alias("parsed"), F.lit(True).alias("in_index")
    )
    listed = catalogue.select(
        "db_id", F.transform("table_names_original", F.lower).alias("expected"), F.lit(True).alias("in_catalogue")
    )
    both = F.col("in_index") & F.col("in_catalogue")
    joined = indexed.join(listed, "db_id", "full_outer").na.fill(False, ["in_index", "in_catalogue"])
    return joined.select(
        "db_id",
        F.when(both, "matched").when(F.col("in_index"), "index only").otherwise("catalogue only").alias("status"),
        F.when(both, F.array_sort(F.array_except("expected", "parsed"))).alias("missing"),
        F.when(both, F.array_sort(F.array_except("parsed", "expected"))).alias("extra"),
    )


def cross_reference_summary(compared: DataFrame) -> DataFrame:
    status = F.col("status")
    counted = compared.agg(
        F.count_if(status != "index only").alias("total_in_catalogue"),
        F.count_if(status != "catalogue only").alias("total_in_index"),
        F.count_if(status == "matched").alias("matched"),
        F.count_if(status == "catalogue only").alias("in_catalogue_only"),
        F.count_if(status == "index only").alias("in_index_only"),
        F.count_if((F.size("missing") > 0) | (F.size("extra") > 0)).alias("table_mismatches"),
    )
    rate = F.when(F.col("total_in_catalogue") > 0, F.col("matched") / F.col("total_in_catalogue") * 100)
    return counted.withColumn("match_rate", F.round(F.coalesce(rate, F.lit(0.0)), 1))


def catalogue_check(schemas: DataFrame) -> DataFrame:
    """Broken dialect rules per finished schema; an absent DDL is itself a finding."""
    ddl = F.col("ddl")
    found = F.when(ddl.isNull(), F.array(F.lit("File not found"))).otherwise(d.catalogue_findings(ddl))
    return explode_present(schemas, ["db_id"], found, "finding")


def catalogue_questions(catalogue: DataFrame, name: str | None = None) -> DataFrame:
    """Sample questions, of one schema or of all; an unknown name gives no rows."""
    rows = catalogue if name is None else catalogue.where(F.col("name") == name)
    return rows.select("name", F.posexplode("sample_questions").alias("pos", "question"))
