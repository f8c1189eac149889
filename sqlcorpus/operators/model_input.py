"""Rendering conversations for a model and fitting them into its sequence length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sqlcorpus import fixed_values as fv
from sqlcorpus.functions import sqltext as st
from sqlcorpus.functions.text import token_count, tokens
from sqlcorpus.operators.skew import join_wide
from sqlcorpus.session import stage


def last_per_role(turns: DataFrame) -> DataFrame:
    """One row per conversation: the last system, user and assistant text (empty when absent).

    ``max_by`` keeps one text per role and conversation in the map-side aggregate, so a conversation
    with very many turns never gathers in one task.
    """

    def last(role: str):
        is_role = F.col("role") == role
        return F.coalesce(F.max_by(F.when(is_role, F.col("text")), F.when(is_role, F.col("turn"))), F.lit(""))

    return turns.groupBy("conv_id").agg(*[last(role).alias(role) for role in fv.ROLES])


def render_conversations(turns: DataFrame) -> DataFrame:
    """``(conv_id, system, user, assistant, prompt, text)`` for long-form conversations."""
    return with_rendering(last_per_role(turns))


def render_messages(chat: DataFrame, *keep: str) -> DataFrame:
    """The same for rows with a ``messages`` array."""
    roles = [st.last_content(F.col("messages"), role).alias(role) for role in fv.ROLES]
    return with_rendering(chat.select(*keep, *roles))


def with_rendering(parts: DataFrame) -> DataFrame:
    system, user, answer = (F.col(role) for role in fv.ROLES)
    return parts.withColumn("prompt", st.instruction_prompt(system, user)).withColumn(
        "text", st.instruction_text(system, user, answer)
    )


def sequence_budget(rendered: DataFrame, max_length: int = fv.MAX_SEQUENCE) -> DataFrame:
    """Add token counts, what truncation cuts, and the padding, by white-space tokens.

    Prompt and answer are separated by a space, so their counts add up and no text is scanned twice.
    """
    answer = F.concat(F.coalesce(F.col("assistant"), F.lit("")), F.lit(fv.END_OF_TEXT))
    counted = rendered.withColumn("_prompt_tokens", token_count(F.col("prompt"))).withColumn(
        "n_tokens", F.col("_prompt_tokens") + token_count(answer)
    )
    return _with_budget(counted, max_length)


def _with_budget(counted: DataFrame, max_length: int) -> DataFrame:
    n = F.col("n_tokens")
    return (
        counted.withColumn("kept_tokens", F.least(n, F.lit(max_length)))
        .withColumn("pad_tokens", F.greatest(F.lit(max_length) - n, F.lit(0)))
        .withColumn("truncated", n > max_length)
        .withColumn("answer_lost", F.col("_prompt_tokens") >= max_length)
        .drop("_prompt_tokens")
    )


def example_budget(
    examples: DataFrame,
    schemas: DataFrame,
    ddl_col: str = "ddl",
    sql_col: str = "sql",
    max_length: int = fv.MAX_SEQUENCE,
) -> DataFrame:
    """The budget of rendered examples without rendering them.

    All parts of the template are separated by white space, so token counts add up. Schemas are counted
    once per database and only the counts are joined; no schema text is copied into an example.
    """
    fixed = "".join((fv.INSTRUCTION_OPEN, fv.SYSTEM_PROMPT, "\n", *fv.USER_PARTS, fv.INSTRUCTION_CLOSE))
    counts = schemas.where(F.col("ddl").isNotNull()).select(
        "db_id", token_count(F.col(ddl_col)).alias("_schema_tokens"), F.lit(True).alias("_known")
    )
    joined = join_wide(examples, counts, "db_id", "id", ["db_id"]).where(F.col("_known")).drop("_known")
    prompt = (
        F.lit(len(fixed.split())) + F.col("_schema_tokens") + token_count(F.col("db_id")) + token_count(F.col("question"))
    )
    answer = token_count(F.concat(F.col(sql_col), F.lit(fv.END_OF_TEXT)))
    counted = joined.withColumn("_prompt_tokens", prompt).withColumn("n_tokens", F.col("_prompt_tokens") + answer)
    return _with_budget(counted.drop("_schema_tokens"), max_length)


def budget_summary(budgeted: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    return budgeted.agg(
        total.alias("n_rows"),
        F.count_if("truncated").alias("n_truncated"),
        F.count_if("answer_lost").alias("n_answer_lost"),
        F.max("n_tokens").alias("max_tokens"),
        F.round(F.try_divide(F.count_if("truncated"), total) * 100, 1).alias("pct_truncated"),
    )


def truncated_tokens(text, max_length: int = fv.MAX_SEQUENCE):
    """The kept white-space tokens as an array column."""
    return F.slice(tokens(text), 1, max_length)


def fixed_length(df: DataFrame, ids_col: str, max_length: int = fv.MAX_SEQUENCE, pad_id: int = 0) -> DataFrame:
    """``input_ids, attention_mask, labels`` of exactly ``max_length`` from an array of token ids."""
    kept = F.slice(F.col(ids_col), 1, max_length)
    n = F.least(F.size(F.col(ids_col)), F.lit(max_length))
    return (
        df.withColumn("input_ids", F.concat(kept, F.array_repeat(F.lit(pad_id), F.lit(max_length) - n)))
        .withColumn(
            "attention_mask",
            F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n)),
        )
        .withColumn("labels", F.col("input_ids"))
    )


def token_dictionary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``(token, n, token_id)``: ids from 1 by falling frequency, ties by token; 0 is left for padding.

    The counts are range-partitioned and sorted; ids are the place within a partition plus the sizes of the
    partitions before it, so no single task ranks all tokens.
    """
    counts = texts.select(F.explode(tokens(F.col(text_col))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ordered = counts.repartitionByRange(F.desc("n"), "token").sortWithinPartitions(F.desc("n"), "token")
    part = F.spark_partition_id()
    placed = stage(ordered.select("token", "n", part.alias("_part"), F.monotonically_increasing_id().alias("_at")), "token-dictionary")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"), F.min("_at").alias("_first"))
    before = F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")  # one row per partition
    starts = sizes.select("_part", before.alias("_before"), "_first")
    return placed.join(F.broadcast(starts), "_part").select(
        "token", "n", (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int").alias("token_id"))


def model_tensors(
    rendered: DataFrame, dictionary: DataFrame, id_col: str, text_col: str = "text", max_length: int = fv.MAX_SEQUENCE
) -> DataFrame:
    """``id_col, input_ids, attention_mask, labels`` of white-space tokens numbered by ``token_dictionary``.

    Only the tokens that truncation keeps are looked up; frequent tokens meet their ids by salted keys.
    A token outside the dictionary counts as padding's id 0.
    """
    kept = rendered.select(id_col, F.posexplode_outer(truncated_tokens(F.col(text_col), max_length)).alias("pos", "token"))
    known = join_wide(kept, dictionary.select("token", "token_id"), "token", "pos", ["token"])
    place = F.when(F.col("token").isNotNull(), F.struct("pos", F.coalesce("token_id", F.lit(0)).alias("token_id")))
    ids = F.transform(F.sort_array(F.collect_list(place)), lambda p: p["token_id"])
    return fixed_length(known.groupBy(id_col).agg(ids.alias("token_ids")), "token_ids", max_length).drop("token_ids")


Encoder = Callable[[list[str]], list[list[int]]]


def encode(df: DataFrame, text_col: str, make_encoder: Callable[[], Encoder], ids_col: str = "token_ids") -> DataFrame:
    """Run a supplied tokenizer in Arrow batches; it is built once per Python worker."""

    @F.pandas_udf("array<int>")
    def encode_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for batch in batches:
            yield pd.Series(encoder(batch.fillna("").tolist()))

    return df.withColumn(ids_col, encode_batches(F.col(text_col)))


def tokenised(
    rendered: DataFrame, make_encoder: Callable[[], Encoder], max_length: int = fv.MAX_SEQUENCE, pad_id: int = 0
) -> DataFrame:
    """Rendered text to model tensors in array form."""
    return fixed_length(encode(rendered, "text", make_encoder), "token_ids", max_length, pad_id).drop("token_ids")


def demo_prompts(requests: DataFrame) -> DataFrame:
    """Demo prompt per ``(schema, question)``; blank input gives an error row."""
    prompt = st.demo_prompt(F.col("schema"), F.col("question"))
    return requests.withColumn("prompt", prompt).withColumn("is_error", F.col("prompt").startswith("Error: "))


def load_training_data(
    train: DataFrame, validation: DataFrame, order_cols: list[str], max_samples: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rendered train and validation rows from tolerant-reader output with ``messages``.

    ``max_samples`` caps each side to its first rows in file order, for a trial run.
    """

    def side(chat: DataFrame) -> DataFrame:
        rows = chat.orderBy(*order_cols).limit(max_samples) if max_samples else chat
        return render_messages(rows, *order_cols)

    return side(train), side(validation)
