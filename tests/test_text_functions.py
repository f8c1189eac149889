"""Literal cases of the column functions."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from sqlcorpus import fixed_values as fv
from sqlcorpus.functions import dialect as dl
from sqlcorpus.functions import features as ft
from sqlcorpus.functions import sqltext as st
from sqlcorpus.functions import text as tx

CLEAN = [
    ("SELECT   *   FROM   users   WHERE   id = 1", "SELECT * FROM users WHERE id = 1;"),
    ("SELECT *\n        FROM users\n        WHERE id = 1", "SELECT * FROM users WHERE id = 1;"),
    ("SELECT * FROM users;", "SELECT * FROM users;"),
    ("SELECT * FROM users ; ", "SELECT * FROM users ;"),
    ("SELECT\t*\tFROM\tusers", "SELECT * FROM users;"),
    ("", ""),
    (None, ""),
    ("   ", ";"),
    ("a" + chr(160) + chr(8195) + "b", "a b;"),
]


def test_clean_query(evaluate):
    assert evaluate(st.clean_query, [c for c, _ in CLEAN]) == [e for _, e in CLEAN]


REWRITE = [
    ("SELECT * FROM users WHERE created_at > DATETIME('now')", "SELECT * FROM users WHERE created_at > CURRENT_TIMESTAMP"),
    ('x > datetime( "now" )', "x > CURRENT_TIMESTAMP"),
    ("x = DATE('now')", "x = CURRENT_DATE"),
    ("x = TIME('now')", "x = CURRENT_TIME"),
    ("DATETIME('now', '-3 day')", "CURRENT_TIMESTAMP - INTERVAL '3 DAYS'"),
    ("DATETIME('now','+12 Hours')", "CURRENT_TIMESTAMP + INTERVAL '12 HOURS'"),
    ("DATETIME('now','7 minute')", "CURRENT_TIMESTAMP + INTERVAL '7 MINUTES'"),
    ("DATETIME('now','-1 month')", "DATETIME('now','-1 month')"),
    ("DATETIME('now','localtime')", "DATETIME('now','localtime')"),
    ("SELECT strftime('%Y-%m-%d', created_at) FROM users", "SELECT TO_CHAR(created_at, 'YYYY-MM-DD') FROM users"),
    ("strftime('%H:%M:%S', d ), '%Y'", "TO_CHAR(d, 'HH24:MI:SS'), '%Y'"),
    ("strftime('%Y', a) = strftime('%m', b)", "TO_CHAR(a, 'YYYY') = TO_CHAR(b, 'MM')"),
    ("strftime('%Y', datetime('now'))", "TO_CHAR(CURRENT_TIMESTAMP, 'YYYY')"),
    ("strftime('%Y', a) || '" + chr(0xE002) + "'", "TO_CHAR(a, 'YYYY') || '" + chr(0xE002) + "'"),
    ("SELECT SUBSTR(name, 1, 3) FROM users", "SELECT SUBSTRING(name FROM 1 FOR 3) FROM users"),
    ("SUBSTR(a,1,2), substr( b , 3,4)", "SUBSTRING(a FROM 1 FOR 2), SUBSTRING(b FROM 3 FOR 4)"),
    ("SUBSTR(UPPER(name), 2, 2)", "SUBSTRING(UPPER(name) FROM 2 FOR 2)"),
    ("SUBSTR(name, n, 3)", "SUBSTR(name, n, 3)"),
    ("first_name || ' ' || last_name", "first_name || ' ' || last_name"),
    ("SELECT * FROM users WHERE id = 1", "SELECT * FROM users WHERE id = 1"),
    ("my_substr(a, 1, 2)", "my_substr(a, 1, 2)"),
    ("price = $1 AND d < DATE('now')", "price = $1 AND d < CURRENT_DATE"),
    ("", ""),
    (None, None),
]


def test_rewrite_query(evaluate):
    assert evaluate(dl.rewrite_query, [c for c, _ in REWRITE]) == [e for _, e in REWRITE]


def test_rewrite_is_idempotent(evaluate):
    once = evaluate(dl.rewrite_query, [c for c, _ in REWRITE])
    assert evaluate(dl.rewrite_query, once) == once


def _strftime_per_match(text):
    def call(m):
        fmt = m[1]
        for theirs, ours in fv.STRFTIME_FORMATS:
            fmt = fmt.replace(theirs, ours)
        return f"TO_CHAR({m[2].strip()}, '{fmt}')"

    return re.sub(r"""\bstrftime\s*\(\s*['"]([^'"]+)['"]\s*,\s*([^)]+)\)""", call, text, flags=re.I)


def test_strftime_equals_a_rewrite_per_match(evaluate):
    marks = [chr(c) for c in (0xE002, 0xE003, 0xE004)]
    texts = [c for c, _ in REWRITE if c] + [
        f"'%Y{marks[0]}' strftime('%Y%%m {marks[1]}%d', {marks[2]}0 x ) '{marks[2]}1%H{marks[1]}'",
        "strftime('%Y', a), '%Y', STRFTIME( \"%H:%M\" , b ) || '%S'",
        "strftime('%s %j %Y', a",
    ]
    assert evaluate(dl._rewrite_strftime, texts) == [_strftime_per_match(t) for t in texts]


def test_needs_rewrite_covers_all_rules(evaluate):
    changed = [c for c, e in REWRITE if c and c != e]
    assert all(evaluate(dl.query_needs_rewrite, changed))


NORMAL = [
    ("SELECT COUNT(*) FROM users;", "select count(*) from users"),
    ("  select  count(*)   from   users  ;  ", "select count(*) from users"),
    ("A;;;", "a"),
    (None, ""),
]


def test_normalise(evaluate):
    assert evaluate(st.normalise_query, [c for c, _ in NORMAL]) == [e for _, e in NORMAL]


def test_completions(evaluate):
    texts = ["<s>[INST] q [/INST] SELECT 1;</s>", "  SELECT 2 </s> x", "a [/INST] b [/INST] c</s>d [INST] e"]
    assert evaluate(st.completion, texts) == ["SELECT 1;", "SELECT 2  x", "cd [INST] e"]
    assert evaluate(st.demo_completion, texts) == ["SELECT 1;", "SELECT 2", "c"]


RESIDUE = [
    ("SELECT * FROM users WHERE created_at > CURRENT_TIMESTAMP", []),
    ("x > DATETIME('now')", ["DATETIME('now') not converted", "TIME('now') not converted"]),
    ("id INTEGER PRIMARY KEY AUTOINCREMENT", ["AUTOINCREMENT not converted"]),
    ("PRAGMA foreign_keys = ON", ["PRAGMA statement not removed"]),
    ("x\nPRAGMA foreign_keys = ON", []),
]


def test_residue(evaluate):
    assert evaluate(dl.residue, [c for c, _ in RESIDUE]) == [e for _, e in RESIDUE]
    per_line = evaluate(lambda c: dl.residue(c, per_line=True), [RESIDUE[-1][0]])
    assert per_line == [["PRAGMA statement not removed"]]


def test_detection(evaluate):
    def found(text):
        names = list(dl.detected_patterns(F.lit("")))
        values = evaluate(lambda c: F.array(*dl.detected_patterns(c).values()), [text])[0]
        return {n for n, v in zip(names, values) if v}

    assert found("SELECT a || b FROM t") == {"concatenation"}
    assert found("SELECT DATETIME('now')") == {"datetime_now", "time_now"}
    assert found("id INTEGER AUTOINCREMENT") == {"autoincrement"}
    assert found("PRAGMA foreign_keys = ON") == {"pragma"}
    assert found("SELECT * FROM users") == set()


CLASSES = [
    ("SELECT * FROM users WHERE id = 1;", 1, "simple"),
    ("SELECT u.name, o.total FROM users u JOIN orders o ON u.id = o.user_id;", 2, "medium"),
    ("SELECT category, COUNT(*) FROM products GROUP BY category;", 2, "medium"),
    ("SELECT * FROM users WHERE id IN (SELECT user_id FROM orders WHERE total > 100);", 3, "complex"),
    ("SELECT * FROM a JOIN b ON a.id = b.a_id JOIN c ON b.id = c.b_id JOIN d ON c.id = d.c_id;", 3, "complex"),
    ("SELECT a FROM b UNION SELECT c FROM d", 3, "complex"),
    ("SELECT MAX(x) FROM (SELECT COUNT(*) AS x FROM t GROUP BY y)", 4, "very_complex"),
    ("SELECT 1 FROM a WHERE x IN (SELECT 1 FROM b WHERE y IN (SELECT 1 FROM c))", 4, "complex"),
    ("SELECT MAX(x) FROM t WHERE y > (SELECT 1)", 3, "very_complex"),
]


def test_classes(spark):
    df = ft.with_upper(spark.createDataFrame([(c,) for c, _, _ in CLASSES], "sql string"))
    upper = F.col(ft.UPPER)
    rows = df.select("sql", ft.split_class(upper).alias("a"), ft.report_label(upper).alias("b")).collect()
    assert {(r.sql, r.a, r.b) for r in rows} == set(CLASSES)


def test_class_labels(evaluate):
    assert evaluate(ft.class_label, [1, 2, 3, 4, 5, None], "int") == [
        "simple", "medium", "complex", "very_complex", "unknown", "unknown",
    ]


def test_features(spark):
    sql = (
        "SELECT u.name, COUNT(o.id) FROM users u LEFT JOIN orders o ON u.id = o.user_id "
        "GROUP BY u.name HAVING COUNT(o.id) > 5 ORDER BY COUNT(o.id) DESC LIMIT 10;"
    )
    df = ft.with_upper(spark.createDataFrame([(sql,)], "sql string"))
    columns = {**ft.flag_columns(F.col(ft.UPPER)), **ft.count_columns(F.col(ft.UPPER))}
    row = df.select(*[c.alias(n) for n, c in columns.items()]).first().asDict()
    true = {n for n, v in row.items() if v is True}
    assert true == {
        "has_select", "has_join", "has_left_join", "has_group_by", "has_having", "has_order_by", "has_limit",
        "has_count", "has_aggregation",
    }
    assert (row["join_count"], row["subquery_count"], row["table_count"]) == (1, 0, 2)
    assert len(columns) == 34


texts = hs.lists(
    hs.text(alphabet=hs.sampled_from(list("ab;(') \t\n\x1c\x85") + [chr(160), chr(8195), chr(12288), "é", "漢"]), max_size=30),
    min_size=20, max_size=40,
)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts)
def test_white_space_functions_follow_unicode_split(evaluate, values):
    assert evaluate(tx.collapse, values) == [" ".join(v.split()) for v in values]
    assert evaluate(tx.strip, values) == [v.strip() for v in values]
    assert evaluate(tx.strip_long, values) == [v.strip() for v in values]
    assert evaluate(tx.token_count, values) == [len(v.split()) for v in values]
    assert evaluate(tx.tokens, values) == [v.split() for v in values]
    assert evaluate(tx.is_blank, values) == [not v.strip() for v in values]


USER = "Database: shop\n\nSchema:\nCREATE TABLE t (id int);\n\nQuestion: How many?\n\nGenerate the SQL query:"


def test_user_message_round_trip(spark, evaluate):
    df = spark.createDataFrame([("shop", "CREATE TABLE t (id int);", "How many?")], "d string, s string, q string")
    assert df.select(st.user_message(F.col("d"), F.col("s"), F.col("q"))).first()[0] == USER
    assert evaluate(st.schema_section, [USER, "no marks"]) == ["CREATE TABLE t (id int);", ""]
    assert evaluate(st.question_section, [USER, "no marks"]) == ["How many?", ""]
    assert evaluate(st.database_section, [USER, "no marks"]) == ["shop", None]
    assert evaluate(lambda c: st.splice_schema(c, F.lit("NEW")), [USER]) == [USER.replace("CREATE TABLE t (id int);", "NEW")]


def test_question_without_closing_mark(evaluate):
    text = "Schema:\nx\n\nQuestion: abc"
    assert evaluate(st.question_section, [text]) == ["ab"]


def test_demo_prompt(spark):
    df = spark.createDataFrame([(" s ", " q\n"), ("", "q"), ("s", " "), (None, None)], "s string, q string")
    out = [r[0] for r in df.select(st.demo_prompt(F.col("s"), F.col("q"))).collect()]
    assert out[0] == fv.DEMO_PROMPT[0] + "s" + fv.DEMO_PROMPT[1] + "q" + fv.DEMO_PROMPT[2]
    assert out[1:] == [fv.DEMO_NO_SCHEMA, fv.DEMO_NO_QUESTION, fv.DEMO_NO_SCHEMA]


@pytest.mark.parametrize("mode,expected", [("substring", {"IN": 1, "MIN": 1, "COUNT": 1}), ("word", {"MIN": 1})])
def test_keyword_modes(spark, mode, expected):
    from sqlcorpus.operators.checks import keyword_frequency

    df = spark.createDataFrame([("min country",)], "query string")
    assert {r.keyword: r.n for r in keyword_frequency(df, mode=mode).collect()} == expected


def test_subquery_counts_twice(spark):
    from sqlcorpus.operators.checks import keyword_frequency

    df = spark.createDataFrame([("subquery select select",)], "query string")
    assert {r.keyword: r.n for r in keyword_frequency(df).collect()}["SUBQUERY"] == 2
