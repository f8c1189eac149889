"""Text primitives shared by all operators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlcorpus.fixed_values import WHITE_SPACE

# the characters of WHITE_SPACE as a class: controls, then all Unicode separators
_WS = r"\t-\r\x1c-\x20\x85\p{Z}"
_WS_IN_LINE = r"\t\x0b-\r\x1c-\x20\x85\p{Z}"
_WORD = r"[\p{L}\p{N}_]"


def regex(pattern: str, *, in_line: bool = False, flags: str = "i") -> str:
    """Spell out ``\\s \\w \\d \\b`` as Unicode classes; ``in_line`` keeps matches inside one line.

    With ``in_line`` the anchors ``^`` and ``$`` work per line and only ``\\n`` ends a line. Letters of
    the pattern match both ASCII cases, as SQL keywords do.
    """
    space = _WS_IN_LINE if in_line else _WS
    out = pattern.replace(r"\s", f"[{space}]").replace(r"\w", _WORD).replace(r"\d", r"\p{Nd}")
    # patterns put \b next to a letter. A leading boundary is tested after its letter has matched, since
    # a look-behind tried at every position is what makes such patterns slow
    out = re.sub(r"\\b([A-Za-z])", lambda m: f"{m[1]}(?<!{_WORD}.)", out)
    out = out.replace(r"\b", rf"(?!{_WORD})")
    mode = flags + ("md" if in_line else "")
    return f"(?{mode}){out}" if mode else out


def has(col: Column, pattern: str, **kw) -> Column:
    return F.rlike(col, F.lit(regex(pattern, **kw)))


def sub(col: Column, pattern: str, replacement: str, **kw) -> Column:
    return F.regexp_replace(col, F.lit(regex(pattern, **kw)), F.lit(replacement))


def find_all(col: Column, pattern: str, group: int = 1, **kw) -> Column:
    return F.regexp_extract_all(col, F.lit(regex(pattern, **kw)), F.lit(group))


def count_matches(col: Column, pattern: str, **kw) -> Column:
    return F.regexp_count(col, F.lit(regex(pattern, **kw)))


def contains_any(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words])


def count_literal(col: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal word."""
    gone = F.length(col) - F.length(F.replace(col, F.lit(word), F.lit("")))
    return (gone / F.lit(len(word))).cast("int")


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE_SPACE))


def strip_long(col: Column) -> Column:
    """Same result as ``strip``; needs no per-character side arrays, so fit for very long texts."""
    return F.regexp_replace(
        F.regexp_replace(col, F.lit(rf"\A[{_WS}]+"), F.lit("")),
        F.lit(rf"(?<![{_WS}])[{_WS}]+\z"),
        F.lit(""),
    )


def is_blank(col: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return ~F.rlike(F.coalesce(col, F.lit("")), F.lit(rf"[^{_WS}]"))


def collapse(col: Column) -> Column:
    """Every run of white space becomes one space; ends are stripped."""
    return F.trim(F.regexp_replace(col, F.lit(rf"[{_WS}]+"), F.lit(" ")))


def token_count(col: Column) -> Column:
    """Number of white-space separated tokens; 0 for null or blank."""
    return F.coalesce(F.regexp_count(col, F.lit(rf"[^{_WS}]++")), F.lit(0))


def tokens(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(rf"[^{_WS}]++"), F.lit(0))


def between(col: Column, start: Column, end: Column) -> Column:
    """Slice by zero-based [start, end) positions, empty when end <= start."""
    return F.when(end > start, F.substring(col, start + 1, end - start)).otherwise(F.lit(""))


def position(col: Column, mark: str) -> Column:
    """Zero-based position of the first occurrence, -1 when absent."""
    return F.instr(col, mark) - 1


def explode_present(df: DataFrame, keep: list[Column | str], items: Column, *names: str) -> DataFrame:
    """One row per array element; with two names the position comes first.

    The outer form is used with a filter on its output: for the inner form the optimizer adds a filter
    on the array itself, which computes the array twice.
    """
    generator = F.posexplode_outer(items) if len(names) == 2 else F.explode_outer(items)
    return df.select(*keep, generator.alias(*names)).where(F.col(names[-1]).isNotNull())


def non_null(*items: Column) -> Column:
    return F.array_compact(F.array(*items))
