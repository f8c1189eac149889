"""Query features and complexity classes.

All tests are substring tests on the upper-cased query. Upper-case once in an own projection
(``with_upper``) and build the features from that column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlcorpus import fixed_values as fv
from sqlcorpus.functions.text import contains_any, count_literal, count_matches

UPPER = "_sql_upper"


def with_upper(df: DataFrame, sql_col: str = "sql") -> DataFrame:
    return df.withColumn(UPPER, F.upper(F.coalesce(F.col(sql_col), F.lit(""))))


def join_count(upper: Column) -> Column:
    return F.when(upper.contains("JOIN"), count_matches(upper, fv.JOIN_WORD, flags="")).otherwise(F.lit(0))


def select_count(upper: Column) -> Column:
    return count_literal(upper, "SELECT")


def subquery_count(upper: Column) -> Column:
    return F.greatest(F.lit(0), select_count(upper) - 1)


def table_count(upper: Column) -> Column:
    from_count = F.when(upper.contains("FROM"), count_matches(upper, fv.FROM_WORD, flags="")).otherwise(F.lit(0))
    return from_count + join_count(upper)


def has_subquery(upper: Column) -> Column:
    return select_count(upper) > 1


def flag_columns(upper: Column) -> dict[str, Column]:
    """The boolean features, by name."""
    flags = {"has_select": upper.startswith("SELECT") | upper.contains(" SELECT ")}
    flags.update({name: contains_any(upper, words) for name, words in fv.FEATURE_WORDS.items()})
    flags["has_subquery"] = has_subquery(upper)
    return flags


def count_columns(upper: Column) -> dict[str, Column]:
    return {
        "join_count": join_count(upper),
        "subquery_count": subquery_count(upper),
        "table_count": table_count(upper),
    }


def split_class(upper: Column) -> Column:
    """Class used for stratified splits, 1 (simple) to 4 (very complex)."""
    words = fv.FEATURE_WORDS
    joined_or_grouped = contains_any(upper, words["has_join"]) | contains_any(upper, words["has_group_by"])
    aggregated = contains_any(upper, words["has_aggregation"])
    grouped = contains_any(upper, words["has_group_by"])
    set_operation = contains_any(upper, words["has_union"] + words["has_except"] + words["has_intersect"])
    selects = select_count(upper)
    return (
        F.when((selects >= 3) | ((selects > 1) & aggregated & grouped), F.lit(4))
        .when((selects > 1) | set_operation | (join_count(upper) >= 2), F.lit(3))
        .when(joined_or_grouped, F.lit(2))
        .otherwise(F.lit(1))
    )


def class_label(level: Column) -> Column:
    label = F.when(level == 1, F.lit(fv.CLASS_LABELS[1]))
    for number in (2, 3, 4):
        label = label.when(level == number, F.lit(fv.CLASS_LABELS[number]))
    return label.otherwise(F.lit(fv.UNKNOWN_LABEL))


def report_label(upper: Column) -> Column:
    """Class used in statistics reports; differs from ``split_class`` by design."""
    words = fv.FEATURE_WORDS
    nested = has_subquery(upper)
    return (
        F.when(nested & contains_any(upper, words["has_aggregation"]), F.lit(fv.CLASS_LABELS[4]))
        .when(nested | (join_count(upper) >= 2), F.lit(fv.CLASS_LABELS[3]))
        .when(
            contains_any(upper, words["has_join"]) | contains_any(upper, words["has_group_by"]),
            F.lit(fv.CLASS_LABELS[2]),
        )
        .otherwise(F.lit(fv.CLASS_LABELS[1]))
    )
