"""From raw examples and schemas to chat examples, with full accounting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlcorpus import fixed_values as fv
from sqlcorpus.functions import sqltext as st
from sqlcorpus.functions.features import with_upper, UPPER, flag_columns
from sqlcorpus.functions.text import is_blank
from sqlcorpus.operators.checks import violations
from sqlcorpus.operators.schemas import has_ddl
from sqlcorpus.operators.skew import BROADCAST_BYTES, join_wide
from sqlcorpus.sources.readers import JSON_OPTIONS, is_valid_json

EMPTY_QUERY = "skipped_empty_query"
MISSING_SCHEMA = "skipped_missing_schema"
WRITTEN = "written"


def status(query: Column, has_schema: Column) -> Column:
    """The empty-query test comes first, as in the accounting."""
    return (
        F.when(is_blank(query), EMPTY_QUERY).when(~F.coalesce(has_schema, F.lit(False)), MISSING_SCHEMA).otherwise(WRITTEN)
    )


def with_status(examples: DataFrame, schemas: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``status`` per example. Only database ids take part in the join, no schema text.

    A column ``has_ddl`` of ``schemas`` spares the read of the text for its null test.
    """
    known = schemas.where(has_ddl(schemas)).select("db_id", F.lit(True).alias("_known"))
    joined = join_wide(examples, known, "db_id", "id", ["db_id"], broadcast_bytes)
    return joined.withColumn("status", status(F.col("query"), F.col("_known"))).drop("_known")


def attach_schema(
    examples: DataFrame,
    schemas: DataFrame,
    ddl_col: str = "ddl",
    broadcast_bytes: int = BROADCAST_BYTES,
    keep: list[str] | None = None,
    size_bytes: int | None = None,
) -> DataFrame:
    """Left join of the schema text by ``db_id``; ``ddl`` is null where the schema is unknown."""
    wide = schemas.select("db_id", ddl_col, *(keep or []))
    return join_wide(examples, wide, "db_id", "id", [ddl_col], broadcast_bytes, size_bytes)


def usable(examples: DataFrame, schemas: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Examples that will be written, with ``sql``: the cleaned query."""
    kept = with_status(examples.where(~is_blank(F.col("query"))), schemas, broadcast_bytes)
    return kept.where(F.col("status") == WRITTEN).drop("status").withColumn("sql", st.clean_query(F.col("query")))


def chat_columns(with_ddl: DataFrame, ddl_col: str = "ddl", sql_col: str = "sql") -> DataFrame:
    """Flat chat columns ``system, user, assistant`` next to the example columns."""
    return with_ddl.select(
        "*",
        F.lit(fv.SYSTEM_PROMPT).alias("system"),
        st.user_message(F.col("db_id"), F.col(ddl_col), F.col("question")).alias("user"),
        F.col(sql_col).alias("assistant"),
    )


def chat_rows(chat: DataFrame, *keep: str) -> DataFrame:
    """The nested ``messages`` form written to JSON lines."""
    return chat.select(*keep, st.messages(F.col("system"), F.col("user"), F.col("assistant")).alias("messages"))


def convert(examples: DataFrame, schemas: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Chat columns of all usable examples; skipped rows are counted by ``conversion_counts``."""
    kept = examples.where(~is_blank(F.col("query"))).withColumn("sql", st.clean_query(F.col("query")))
    joined = attach_schema(kept, schemas, broadcast_bytes=broadcast_bytes)
    return chat_columns(joined.where(F.col("ddl").isNotNull()))


def conversion_counts(examples: DataFrame, schemas: DataFrame) -> DataFrame:
    """Counters per source. Rows are counted per (source, db_id) first; the join sees only counts."""
    counted = examples.groupBy("source", "db_id", is_blank(F.col("query")).alias("blank")).agg(
        F.count(F.lit(1)).alias("n")
    )
    known = schemas.where(has_ddl(schemas)).select("db_id", F.lit(True).alias("known"))
    joined = counted.join(known, "db_id", "left").na.fill(False, ["known"])

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))

    return joined.groupBy("source").agg(
        F.sum("n").alias("total"),
        total(~F.col("blank") & F.col("known")).alias(WRITTEN),
        total(F.col("blank")).alias(EMPTY_QUERY),
        total(~F.col("blank") & ~F.col("known")).alias(MISSING_SCHEMA),
    )


def union_sources(sources: dict[str, DataFrame | None]) -> DataFrame:
    """All present sources with a ``source`` column, so that one job converts them all."""
    present = [df.withColumn("source", F.lit(name)) for name, df in sources.items() if df is not None]
    return reduce(DataFrame.unionByName, present)


def source_errors(spark: SparkSession, sources: dict[str, DataFrame | None], rejects: DataFrame | None = None) -> DataFrame:
    """``(source, error)``: missing sources, and broken files from ``rejects(file, reason)`` of the reader."""
    missing = [(name, f"File not found: {name}") for name, df in sources.items() if df is None]
    found = spark.createDataFrame(missing, "source string, error string")
    if rejects is None:
        return found
    return found.unionByName(rejects.select(F.col("file").alias("source"), F.col("reason").alias("error")))


CONSTRUCTS = {
    "with_join": "has_join",
    "with_group_by": "has_group_by",
    "with_subquery": "has_subquery",
    "with_order_by": "has_order_by",
    "with_limit": "has_limit",
    "with_having": "has_having",
    "with_distinct": "has_distinct",
    "with_aggregation": "has_aggregation",
}
CONSTRUCT_PERCENTAGES = [
    "simple_select", "with_join", "with_group_by", "with_subquery", "with_order_by", "with_aggregation",
]


def construct_report(examples: DataFrame, sql_col: str = "sql") -> DataFrame:
    """Counts of query constructs, and percentages for six of them, as one global aggregate."""
    flags = flag_columns(F.col(UPPER))
    counts = [F.count_if(flags[flag]).alias(name) for name, flag in CONSTRUCTS.items()]
    row = with_upper(examples.select(sql_col), sql_col).agg(
        F.count(F.lit(1)).alias("total_examples"), F.count_if(~flags["has_join"]).alias("simple_select"), *counts
    )
    share = {
        f"pct_{name}": F.round(F.try_divide(F.col(name), F.col("total_examples")) * 100, 1)
        for name in CONSTRUCT_PERCENTAGES
    }
    return row.withColumns(share)


# ---- structure check ---------------------------------------------------------------------------

CHAT_LINE = "messages array<struct<role:string,content:string>>"


def chat_line_violations(lines: DataFrame, line_col: str, id_cols: list[str]) -> DataFrame:
    """Structure rules over every JSON line. A rule that ends the check hides the later ones."""
    chat = F.from_json(F.col(line_col), CHAT_LINE, JSON_OPTIONS)["messages"]
    rows = lines.select(
        *id_cols, is_valid_json(F.col(line_col)).alias("_valid"), chat.alias("_m"),
    ).withColumn("_n", F.coalesce(F.size("_m"), F.lit(-1)))
    reached = F.col("_valid") & (F.col("_n") == 3)
    rules: dict[str, Column] = {
        "invalid JSON": F.col("_valid"),
        "missing messages": ~F.col("_valid") | (F.col("_n") >= 0),
        "expected 3 messages": ~F.col("_valid") | F.col("_n").isin(-1, 3),
    }
    for i, role in enumerate(fv.ROLES):
        message = F.get(F.col("_m"), F.lit(i))
        rules[f"message {i} is not {role}"] = ~reached | message["role"].eqNullSafe(F.lit(role))
        rules[f"message {i} has no content"] = ~reached | message["content"].isNotNull()
    user = F.coalesce(F.get(F.col("_m"), F.lit(1))["content"], F.lit(""))
    rules["user message has no schema"] = ~reached | user.contains("Schema:")
    rules["user message has no CREATE TABLE"] = ~reached | user.contains("CREATE TABLE")
    return violations(rows, id_cols, rules)


def conversation_violations(turns: DataFrame) -> DataFrame:
    """The same rules for conversations in long form ``(conv_id, turn, role, text)``.

    One aggregate per conversation with partial aggregation on the map side; no list of turns is built.
    """
    user_turn = F.col("turn") == 1
    # roles as numbers: the aggregate then works in fixed-width buffers, without sorting by conversation
    role_code = F.lit(-1)
    for code, role in enumerate(fv.ROLES):
        role_code = F.when(F.col("role") == role, code).otherwise(role_code)
    per = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.max(F.when(F.col("turn") == i, role_code)).alias(f"role_{i}") for i in range(3)],
        *[F.bool_or((F.col("turn") == i) & F.col("text").isNotNull()).alias(f"has_{i}") for i in range(3)],
        F.bool_or(user_turn & F.col("text").contains("Schema:")).alias("schema"),
        F.bool_or(user_turn & F.col("text").contains("CREATE TABLE")).alias("tables"),
    )
    reached = F.col("n") == 3
    rules: dict[str, Column] = {"expected 3 messages": reached}
    for i, role in enumerate(fv.ROLES):
        rules[f"message {i} is not {role}"] = ~reached | F.col(f"role_{i}").eqNullSafe(F.lit(i))
        rules[f"message {i} has no content"] = ~reached | F.col(f"has_{i}")
    rules["user message has no schema"] = ~reached | F.col("schema")
    rules["user message has no CREATE TABLE"] = ~reached | F.col("tables")
    return violations(per, ["conv_id"], rules)
