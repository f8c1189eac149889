"""Cleaning, normalising and rendering of query text and conversations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqlcorpus import fixed_values as fv
from sqlcorpus.functions.text import between, collapse, is_blank, position, strip


def clean_query(sql: Column) -> Column:
    """One-line query ending in a semicolon; null and empty text give empty text."""
    closing = F.when(strip(sql).endswith(";"), F.lit("")).otherwise(F.lit(";"))
    empty = F.length(F.coalesce(sql, F.lit(""))) == 0
    return F.when(empty, F.lit("")).otherwise(F.concat(collapse(sql), closing))


def normalise_query(sql: Column) -> Column:
    """Comparison form: lower case, single spaces, no closing semicolons."""
    return strip(F.rtrim(collapse(F.lower(F.coalesce(sql, F.lit("")))), F.lit(";")))


def completion(text: Column) -> Column:
    """Text after the last instruction mark, without end marks."""
    return strip(F.replace(strip(F.substring_index(text, "[/INST]", -1)), F.lit(fv.END_OF_TEXT), F.lit("")))


def demo_completion(text: Column) -> Column:
    """Demo variant: cut at the first end mark and at the first new instruction."""
    tail = strip(F.substring_index(text, "[/INST]", -1))
    return strip(F.substring_index(strip(F.substring_index(tail, fv.END_OF_TEXT, 1)), "[INST]", 1))


def user_message(db_id: Column, ddl: Column, question: Column) -> Column:
    database, schema, ask, closing = fv.USER_PARTS
    return F.concat(
        F.lit(database), db_id, F.lit(schema), ddl, F.lit(ask), question, F.lit(closing)
    )


def messages(system: Column, user: Column, answer: Column) -> Column:
    """``array<struct<role, content>>`` in the fixed role order."""
    return F.array(
        *[
            F.struct(F.lit(role).alias("role"), content.alias("content"))
            for role, content in zip(fv.ROLES, (system, user, answer))
        ]
    )


def last_content(chat: Column, role: str) -> Column:
    """Content of the last message of a role, empty when there is none."""
    same_role = F.filter(chat, lambda m: m["role"] == role)
    return F.coalesce(F.get(F.reverse(same_role), F.lit(0))["content"], F.lit(""))


def instruction_prompt(system: Column, user: Column) -> Column:
    """Prompt without the answer; the system part is left out when empty."""
    lead = F.when(F.coalesce(system, F.lit("")) != "", F.concat(system, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(F.lit(fv.INSTRUCTION_OPEN), lead, F.coalesce(user, F.lit("")), F.lit(fv.INSTRUCTION_CLOSE))


def instruction_text(system: Column, user: Column, answer: Column) -> Column:
    return F.concat(
        instruction_prompt(system, user), F.lit(" "), F.coalesce(answer, F.lit("")), F.lit(fv.END_OF_TEXT)
    )


def demo_prompt(schema: Column, question: Column) -> Column:
    """Demo template; blank input gives the error text instead of a prompt."""
    opening, ask, closing = fv.DEMO_PROMPT
    return (
        F.when(is_blank(schema), F.lit(fv.DEMO_NO_SCHEMA))
        .when(is_blank(question), F.lit(fv.DEMO_NO_QUESTION))
        .otherwise(F.concat(F.lit(opening), strip(schema), F.lit(ask), strip(question), F.lit(closing)))
    )


# ---- reading foreign chat rows ----------------------------------------------------------------


def has_sections(user: Column) -> Column:
    return (position(user, fv.SCHEMA_MARK) >= 0) & (position(user, fv.QUESTION_MARK) >= 0)


def schema_section(user: Column) -> Column:
    """Schema text of a user message; empty when a section mark is missing."""
    start = position(user, fv.SCHEMA_MARK) + len(fv.SCHEMA_MARK)
    return F.when(has_sections(user), between(user, start, position(user, fv.QUESTION_MARK))).otherwise(F.lit(""))


def question_section(user: Column) -> Column:
    """Question text; a missing closing mark drops the last character, as a slice to -1 does."""
    start = position(user, fv.QUESTION_MARK) + len(fv.QUESTION_MARK)
    closing = position(user, fv.ANSWER_MARK)
    end = F.when(closing >= 0, closing).otherwise(F.length(user) - 1)
    return F.when(has_sections(user), strip(between(user, start, end))).otherwise(F.lit(""))


def database_section(user: Column) -> Column:
    """Database name on the first line, null when the message does not open with one."""
    first_line = F.substring_index(user, "\n", 1)
    return F.when(
        user.startswith(fv.DATABASE_MARK), strip(F.replace(first_line, F.lit(fv.DATABASE_MARK), F.lit("")))
    )


def splice_schema(user: Column, rewritten: Column) -> Column:
    """The same message with its schema section exchanged; unchanged when a mark is missing."""
    start = position(user, fv.SCHEMA_MARK) + len(fv.SCHEMA_MARK)
    cut = position(user, fv.QUESTION_MARK)
    return F.when(
        has_sections(user),
        F.concat(F.substring(user, F.lit(1), start), rewritten, F.substring(user, cut + 1, F.length(user))),
    ).otherwise(user)
