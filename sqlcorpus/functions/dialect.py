"""SQLite to PostgreSQL rewriting as column expressions.

Query text goes through six ordered rules. DDL text is rewritten with per-line patterns on the whole
text, so no array of lines is built. Every match is rewritten with its own arguments.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqlcorpus import fixed_values as fv
from sqlcorpus.functions.text import contains_any, count_matches, has, strip_long, sub


def _rewrite_offsets(sql: Column) -> Column:
    """``DATETIME('now', '-3 day')`` to ``CURRENT_TIMESTAMP - INTERVAL '3 DAYS'``, per match."""
    for unit in fv.OFFSET_UNITS:
        for sign, digits in (("-", r"-(\d+)"), ("+", r"\+?(\d+)")):
            pattern = fv.DATETIME_OFFSET.replace(r"([+-]?\d+)", digits)
            pattern = pattern.replace("(" + "|".join(f"{u}|{u}s" for u in fv.OFFSET_UNITS) + ")", unit + "s?")
            sql = sub(sql, pattern, f"CURRENT_TIMESTAMP {sign} INTERVAL '$1 {unit.upper()}S'")
    return sql


# private-use characters: brackets around a format string while it is translated, and their escape
_OPEN, _CLOSE, _ESCAPE = chr(0xE002), chr(0xE003), chr(0xE004)
_ESCAPED = [(_ESCAPE, _ESCAPE + "0"), (_OPEN, _ESCAPE + "1"), (_CLOSE, _ESCAPE + "2")]


def _rewrite_strftime(sql: Column) -> Column:
    """Turn each call around with its format in brackets, then translate codes inside brackets only.

    Bracket characters of the text itself are escaped meanwhile. Every step reads the step before once,
    so the chain stays one pass per rule and needs no arrays.
    """
    for char, escaped in _ESCAPED:
        sql = F.replace(sql, F.lit(char), F.lit(escaped))
    pattern = fv.STRFTIME.replace(r"([^)]+)\)", r"([^)]+?)\s*\)")
    out = sub(sql, pattern, f"TO_CHAR($2, '{_OPEN}$1{_CLOSE}')")
    for theirs, ours in fv.STRFTIME_FORMATS:
        out = F.regexp_replace(out, F.lit(f"{theirs}(?=[^{_OPEN}{_CLOSE}]*{_CLOSE})"), F.lit(ours))
    out = F.translate(out, _OPEN + _CLOSE, "")
    for char, escaped in reversed(_ESCAPED):
        out = F.replace(out, F.lit(escaped), F.lit(char))
    return out


def _rewrite_substr(sql: Column) -> Column:
    return sub(sql, fv.SUBSTR, "SUBSTRING($1 FROM $2 FOR $3)")


def rewrite_query(sql: Column) -> Column:
    """All query rules in order; null and empty text pass through."""
    dated = sub(sql, fv.DATETIME_NOW, "CURRENT_TIMESTAMP")
    dated = F.when(has(sql, fv.DATETIME_OFFSET), _rewrite_offsets(dated)).otherwise(dated)
    dated = sub(sub(dated, fv.DATE_NOW, "CURRENT_DATE"), fv.TIME_NOW, "CURRENT_TIME")
    formatted = F.when(has(sql, r"strftime\s*\("), _rewrite_strftime(dated)).otherwise(dated)
    return F.when(query_needs_rewrite(sql), _rewrite_substr(formatted)).otherwise(sql)


def query_needs_rewrite(sql: Column) -> Column:
    """A cheap test that is true for every text any query rule can match: plain word search."""
    return contains_any(F.upper(sql), ["DATE", "TIME", "SUBSTR"])


def query_rule_hits(sql: Column) -> dict[str, Column]:
    """Per query: does each rule apply? Rules see the text as the earlier rules left it."""
    plain_now = sub(sql, fv.DATETIME_NOW, "CURRENT_TIMESTAMP")
    return {
        "datetime_now": has(sql, fv.DATETIME_NOW).cast("int") + has(plain_now, fv.DATETIME_OFFSET).cast("int"),
        "date_now": has(sql, fv.DATE_NOW).cast("int"),
        "time_now": has(sql, fv.TIME_NOW).cast("int"),
        "strftime": has(sql, fv.STRFTIME).cast("int"),
        "substr": has(sql, fv.SUBSTR).cast("int"),
        "concatenation_operators": sql.contains("||").cast("int"),
    }


# ---- DDL ------------------------------------------------------------------------------------


def _drop_lines(ddl: Column, pattern: str) -> Column:
    return sub(ddl, rf"(?:{pattern})(?:\n|\z)", "", in_line=True)


def drop_control_lines(ddl: Column) -> Column:
    """Remove PRAGMA lines and bare BEGIN TRANSACTION / COMMIT lines, in one pass."""
    return _drop_lines(ddl, "|".join((fv.PRAGMA_LINE, fv.BEGIN_LINE, fv.COMMIT_LINE)))


def drop_inserts(ddl: Column) -> Column:
    """Optional first step for very large dumps: single-line data statements are not schema."""
    return _drop_lines(ddl, fv.INSERT_LINE)


def rewrite_ddl(ddl: Column) -> Column:
    out = drop_control_lines(ddl)
    for pattern, replacement in (
        (fv.AUTOINCREMENT_KEY, "SERIAL PRIMARY KEY"),
        (fv.AUTOINCREMENT, "SERIAL"),
        (fv.BLOB, "BYTEA"),
        (fv.REAL, "DOUBLE PRECISION"),
        (fv.DEFAULT_DATETIME_NOW, "DEFAULT CURRENT_TIMESTAMP"),
        (fv.DATETIME_TYPE, "TIMESTAMP"),
    ):
        out = sub(out, pattern, replacement, in_line=True)
    out = F.regexp_replace(out, F.lit(r"\n{3,}"), F.lit("\n\n"))
    return strip_long(out)


def _lines_with(ddl: Column, pattern: str) -> Column:
    return count_matches(ddl, rf"^[^\n]*?(?:{pattern})[^\n]*$", in_line=True)


def ddl_rule_hits(ddl: Column, kept: Column | None = None) -> dict[str, Column]:
    """Per database: number of lines each DDL rule changes.

    ``kept`` is a column already holding ``drop_control_lines(ddl)``.
    """
    kept = drop_control_lines(ddl) if kept is None else kept
    hits = {
        "autoincrement_to_serial": _lines_with(kept, fv.AUTOINCREMENT_KEY)
        + _lines_with(sub(kept, fv.AUTOINCREMENT_KEY, "SERIAL PRIMARY KEY", in_line=True), fv.AUTOINCREMENT),
        "pragma_removals": count_matches(ddl, fv.PRAGMA_LINE, in_line=True),
        "begin_transaction_removals": count_matches(ddl, fv.BEGIN_LINE, in_line=True),
        "commit_removals": count_matches(ddl, fv.COMMIT_LINE, in_line=True),
        "blob_to_bytea": _lines_with(kept, fv.BLOB),
        "real_to_numeric": _lines_with(kept, fv.REAL),
        "datetime_type": _lines_with(
            sub(kept, fv.DEFAULT_DATETIME_NOW, "DEFAULT CURRENT_TIMESTAMP", in_line=True), fv.DATETIME_TYPE
        ),
    }
    return {name: F.coalesce(hit, F.lit(0)) for name, hit in hits.items()}


# ---- detection and residue -------------------------------------------------------------------


def detected_patterns(text: Column) -> dict[str, Column]:
    out = {"concatenation": text.contains("||")}
    out.update({name: has(text, pattern) for name, pattern in fv.DETECTED.items()})
    return out


def residue_tests(text: Column, *, per_line: bool = False) -> list[tuple[Column, str]]:
    """``(test, message)`` per SQLite form; ``per_line`` lets the PRAGMA rule see every line."""
    return [
        (has(text, pattern, in_line=per_line and pattern.startswith("^")), message) for pattern, message in fv.RESIDUE
    ]


def residue_messages(text: Column, *, per_line: bool = False) -> Column:
    """One array slot per form: its message, or null when the form is absent."""
    return F.array(*[F.when(test, F.lit(message)) for test, message in residue_tests(text, per_line=per_line)])


def residue(text: Column, *, per_line: bool = False) -> Column:
    """Messages for SQLite forms still present."""
    return F.array_compact(residue_messages(text, per_line=per_line))


def is_clean(text: Column, *, per_line: bool = False) -> Column:
    return ~reduce(or_, [test for test, _ in residue_tests(text, per_line=per_line)])
