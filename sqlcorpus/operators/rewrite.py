"""Dialect rewriting of whole corpora.

A schema is rewritten once per database, not once per example that carries a copy of it; counters
that are defined per example are the per-database line counts times the examples of that database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlcorpus.functions import dialect as dl
from sqlcorpus.functions import sqltext as st
from sqlcorpus.functions.text import collapse, explode_present
from sqlcorpus.operators.examples import attach_schema, chat_columns
from sqlcorpus.operators.skew import BROADCAST_BYTES, join_wide, measured_bytes
from sqlcorpus.session import stage


# no rule makes text longer than REAL -> DOUBLE PRECISION does
GROWTH = 4


def rewrite_schemas(schemas: DataFrame, drop_inserts: bool = False) -> DataFrame:
    """Add ``pg_ddl``. ``drop_inserts`` removes single-line data statements first (large dumps)."""
    source = dl.drop_inserts(F.col("ddl")) if drop_inserts else F.col("ddl")
    return schemas.withColumn("pg_ddl", dl.rewrite_ddl(source))


def rewrite_queries(examples: DataFrame, sql_col: str = "sql") -> DataFrame:
    return examples.withColumn("pg_sql", dl.rewrite_query(F.col(sql_col)))


def rewrite_examples(
    usable: DataFrame, schemas: DataFrame, drop_inserts: bool = False, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Rewritten chat columns: queries per row, schemas per database, text joined last."""
    known = schemas.where(F.col("ddl").isNotNull())
    bound = measured_bytes(known, ["ddl"]) * GROWTH
    pg = rewrite_schemas(known, drop_inserts).withColumn("_known", F.lit(True))
    joined = attach_schema(rewrite_queries(usable), pg, "pg_ddl", broadcast_bytes, ["_known"], bound)
    return chat_columns(joined.where(F.col("_known")).drop("_known"), "pg_ddl", "pg_sql")


def rewrite_chat(chat: DataFrame) -> DataFrame:
    """Foreign chat rows (``system, user, assistant``): the schema is cut out, rewritten, put back.

    For batches in which few schemas are copied into many rows, ``rewrite_chat_once`` does less work.
    """
    section = dl.rewrite_ddl(st.schema_section(F.col("user")))
    return _with_changes(chat.withColumn("new_user", st.splice_schema(F.col("user"), section)))


def rewrite_chat_once(chat: DataFrame, id_col: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Same result, each distinct schema text rewritten once.

    The distinct texts come from a map-side combined ``distinct``, so a schema copied into a third of
    all rows is shuffled once per task. They are joined back by digest: by broadcast when measured
    small, otherwise with salted hot digests.
    """
    section = st.schema_section(F.col("user"))
    marked = chat.withColumn("_key", F.when(st.has_sections(F.col("user")), F.sha2(section, 256)))
    distinct = marked.where(F.col("_key").isNotNull()).select("_key", section.alias("ddl")).distinct()
    pg = stage(distinct.select("_key", dl.rewrite_ddl(F.col("ddl")).alias("_pg")), "distinct-schemas")
    joined = join_wide(marked, pg, "_key", id_col, ["_pg"], broadcast_bytes)
    spliced = F.when(F.col("_key").isNull(), F.col("user")).otherwise(st.splice_schema(F.col("user"), F.col("_pg")))
    return _with_changes(joined.withColumn("new_user", spliced).drop("_key", "_pg"))


def _with_changes(chat: DataFrame) -> DataFrame:
    different = [~F.col(new).eqNullSafe(F.col(old)) for new, old in (("new_user", "user"), ("new_assistant", "assistant"))]
    return chat.withColumn("new_assistant", dl.rewrite_query(F.col("assistant"))).withColumn(
        "changed", different[0] | different[1]
    )


QUERY_COUNTERS = ["datetime_now", "date_now", "time_now", "strftime", "substr", "concatenation_operators"]
DDL_COUNTERS = [
    "autoincrement_to_serial", "pragma_removals", "begin_transaction_removals", "commit_removals",
    "blob_to_bytea", "real_to_numeric", "datetime_type",
]


def rewrite_accounting(usable: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row of counters. Examples are pre-aggregated per database; only counts are joined."""
    sql, pg_sql, candidate = F.col("sql"), F.col("pg_sql"), F.col("candidate")
    marked = usable.select("db_id", "sql", dl.query_needs_rewrite(sql).alias("candidate"))
    # rule tests and comparisons run only on candidate rows; the || operator needs no candidate
    rewritten = marked.withColumn("pg_sql", F.when(candidate, dl.rewrite_query(sql)).otherwise(sql))
    hits = {
        name: hit.cast("long") if name == "concatenation_operators" else F.when(candidate, hit).otherwise(0).cast("long")
        for name, hit in dl.query_rule_hits(sql).items()
    }
    per_db = rewritten.groupBy("db_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(candidate & (sql != pg_sql)).alias("sql_changed"),
        F.count_if(candidate & (collapse(sql) != collapse(pg_sql))).alias("sql_changed_text"),
        *[F.sum(hit).alias(name) for name, hit in hits.items()],
    )
    kept = rewrite_schemas(schemas).withColumn("kept", dl.drop_control_lines(F.col("ddl")))
    line_hits = dl.ddl_rule_hits(F.col("ddl"), F.col("kept"))
    facts = kept.select(
        "db_id",
        *[hit.cast("long").alias(f"l_{name}") for name, hit in line_hits.items()],
        (F.col("ddl") != F.col("pg_ddl")).alias("ddl_changed"),
        (collapse(F.col("ddl")) != collapse(F.col("pg_ddl"))).alias("ddl_changed_text"),
    )
    joined = per_db.join(facts, "db_id")

    def zero(col):
        return F.coalesce(F.sum(col), F.lit(0))

    return joined.agg(
        zero(F.col("n")).alias("total_examples"),
        zero(F.when(F.col("ddl_changed"), F.col("n")).otherwise(F.col("sql_changed"))).alias("examples_with_conversions"),
        zero(F.when(F.col("ddl_changed_text"), F.col("n")).otherwise(F.col("sql_changed_text"))).alias(
            "changed_beyond_whitespace"
        ),
        *[zero(F.col(f"l_{name}") * F.col("n")).alias(name) for name in DDL_COUNTERS],
        *[zero(F.col(name)).alias(name) for name in QUERY_COUNTERS],
    )


def residue_report(examples: DataFrame, schemas: DataFrame, sql_col: str, ddl_col: str) -> DataFrame:
    """Issues left in all rows: ``(scope, issue, n)``, schema issues counted per carrying example."""
    in_sql = (
        explode_present(examples, [], dl.residue_messages(F.col(sql_col)), "issue")
        .groupBy("issue")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("query").alias("scope"), "issue", "n")
    )
    per_db = examples.groupBy("db_id").agg(F.count(F.lit(1)).alias("n"))
    issues = explode_present(schemas, ["db_id"], dl.residue_messages(F.col(ddl_col), per_line=True), "issue")
    in_ddl = (
        issues.join(per_db, "db_id").groupBy("issue").agg(F.sum("n").alias("n")).select(
            F.lit("schema").alias("scope"), "issue", "n"
        )
    )
    return in_sql.unionByName(in_ddl)


def residue_sample(examples: DataFrame, order_col: str, sql_col: str, n: int = 100) -> DataFrame:
    """Issues in the first ``n`` queries, for a quick look."""
    return explode_present(examples.orderBy(order_col).limit(n), [order_col], dl.residue_messages(F.col(sql_col)), "issue")


def changed_pairs(rewritten: DataFrame, order_col: str, before: str = "sql", after: str = "pg_sql", n: int = 1) -> DataFrame:
    """The first ``n`` rows whose text changed, before and after side by side (top-n, no full sort)."""
    # the changed flag is sorted on and not filtered: a filter would be pushed down to the scan together
    # with the whole rewrite, which would then run twice
    flagged = rewritten.select(
        order_col, "db_id", F.col(before).alias("before"), F.col(after).alias("after"),
        F.coalesce(F.col(before) != F.col(after), F.lit(False)).alias("_changed"),
    )
    return flagged.orderBy(F.desc("_changed"), order_col).limit(n).where("_changed").drop("_changed")
