"""Facts extracted from the DDL text of one database."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sqlcorpus import fixed_values as fv
from sqlcorpus.functions.text import count_literal, find_all, has, is_blank, non_null, regex, strip

_DOTALL = {"flags": "ius"}


def table_names(ddl: Column) -> Column:
    """Names in order of appearance; a repeated name is repeated."""
    return find_all(ddl, fv.TABLE_HEAD)


def column_names(body: Column) -> Column:
    """Column names of one CREATE TABLE body, one definition per line."""
    lines = F.transform(F.split(body, "\n", -1), lambda line: F.rtrim(strip(line), F.lit(",")))
    defined = F.filter(lines, lambda line: (line != "") & ~has(line, fv.CONSTRAINT_LINE))
    names = F.transform(defined, lambda line: F.regexp_extract(line, regex(fv.COLUMN_HEAD), 1))
    return F.filter(names, lambda name: name != "")


def table_blocks(ddl: Column) -> Column:
    """``array<struct<name, body>>`` of the CREATE TABLE statements closed by ``);``."""
    return F.zip_with(
        find_all(ddl, fv.TABLE_BLOCK, 1, **_DOTALL),
        find_all(ddl, fv.TABLE_BLOCK, 2, **_DOTALL),
        lambda name, body: F.struct(name.alias("name"), body.alias("body")),
    )


def table_columns(ddl: Column) -> Column:
    """``array<struct<name, columns>>``; of a repeated table the last definition stays."""
    return F.transform(
        last_definitions(table_blocks(ddl)),
        lambda t: F.struct(t["name"].alias("name"), column_names(t["body"]).alias("columns")),
    )


def last_definitions(blocks: Column) -> Column:
    """Sort by (name, position) and keep the last of each name: n log n in the number of tables."""
    numbered = F.transform(
        blocks, lambda t, i: F.struct(t["name"].alias("name"), i.alias("pos"), t["body"].alias("body"))
    )
    ordered = F.array_sort(numbered)
    following = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered), F.lit(1)))
    paired = F.zip_with(
        ordered, following, lambda t, nxt: F.struct(t.alias("t"), nxt["name"].alias("next_name"))
    )
    kept = F.filter(paired, lambda p: ~p["t"]["name"].eqNullSafe(p["next_name"]))
    return F.transform(kept, lambda p: p["t"])


def foreign_keys(ddl: Column) -> Column:
    """Edges of table-level FOREIGN KEY clauses, in order."""
    pairs = F.zip_with(
        find_all(ddl, fv.FOREIGN_KEY, 2),
        find_all(ddl, fv.FOREIGN_KEY, 3),
        lambda table, col: F.struct(table.alias("t"), col.alias("c")),
    )
    return F.zip_with(
        find_all(ddl, fv.FOREIGN_KEY, 1),
        pairs,
        lambda col, ref: F.struct(
            col.alias("column"), ref["t"].alias("references_table"), ref["c"].alias("references_column")
        ),
    )


def foreign_keys_by_table(ddl: Column) -> Column:
    """``foreign_keys`` in the same order with ``source_table``, null outside the CREATE TABLE statements.

    One walk: each piece of text is a whole statement or a clause that stands outside of one.
    """
    block = regex(fv.TABLE_BLOCK, **_DOTALL)
    pieces = F.regexp_extract_all(ddl, F.lit(f"{block}|{regex(fv.FOREIGN_KEY)}"), F.lit(0))

    def edges(piece: Column) -> Column:
        table = F.nullif(F.regexp_extract(piece, block, 1), F.lit(""))
        return F.transform(foreign_keys(piece), lambda fk: F.struct(table.alias("source_table"), fk.alias("edge")))

    return F.flatten(F.transform(pieces, edges))


def has_foreign_keys(ddl: Column) -> Column:
    return has(ddl, fv.HAS_FOREIGN_KEY)


def has_primary_keys(ddl: Column) -> Column:
    return has(ddl, fv.HAS_PRIMARY_KEY)


def has_pragma(ddl: Column) -> Column:
    return has(ddl, r"\A\s*PRAGMA")


def ddl_warnings(ddl: Column) -> Column:
    """Empty text and text without a table give one message; other findings are warnings."""
    opened, closed = count_literal(ddl, "("), count_literal(ddl, ")")
    findings = non_null(
        F.when(~has_pragma(ddl), F.lit(fv.SCHEMA_NO_PRAGMA)),
        F.when(
            opened != closed,
            F.concat(
                F.lit("Unbalanced parentheses: "), opened.cast("string"),
                F.lit(" open, "), closed.cast("string"), F.lit(" close"),
            ),
        ),
        F.when(~ddl.contains(";"), F.lit(fv.SCHEMA_NO_SEMICOLON)),
    )
    return (
        F.when(is_blank(ddl), F.array(F.lit(fv.SCHEMA_EMPTY)))
        .when(~has(ddl, fv.HAS_CREATE_TABLE), F.array(F.lit(fv.SCHEMA_NO_TABLE)))
        .otherwise(findings)
    )


def ddl_is_valid(ddl: Column) -> Column:
    return ~is_blank(ddl) & F.coalesce(has(ddl, fv.HAS_CREATE_TABLE), F.lit(False))


def catalogue_findings(ddl: Column) -> Column:
    """Dialect rules for a finished PostgreSQL schema (case-sensitive words)."""
    rules = [F.when(ddl.contains(word), F.lit(text)) for word, text in fv.CATALOGUE_FORBIDDEN]
    rules += [F.when(~ddl.contains(word), F.lit(text)) for word, text in fv.CATALOGUE_REQUIRED]
    return non_null(*rules)

