"""DDL extraction, checks and rewrite."""

from pyspark.sql import functions as F

from sqlcorpus import fixed_values as fv
from sqlcorpus.functions import ddl as d
from sqlcorpus.functions import dialect as dl
from sqlcorpus.operators import schemas as sch

SHOP = """PRAGMA foreign_keys = ON;
CREATE TABLE "users" (
"id" INTEGER PRIMARY KEY AUTOINCREMENT,
 name TEXT ,
'mail' text,
unique_code text,
CHECK (id > 0),
PRIMARY KEY ("id")
);

create table if not exists `orders` (
  id int,
  user_id int REFERENCES users(id),
  FOREIGN KEY (`user_id`) REFERENCES "users" ("id")
);
CREATE TABLE one_line (a int, b int);
CREATE TABLE orders (
z int,
y int
);
CREATE TABLE no end (x int)
"""


def _one(spark, ddl):
    return spark.createDataFrame([("db", ddl)], "db_id string, ddl string")


def test_tables_and_columns(spark):
    df = _one(spark, SHOP)
    assert [r.table_name for r in sch.schema_tables(df).orderBy("pos").collect()] == ["users", "orders", "one_line", "orders"]
    columns = {}
    for r in sch.schema_columns(df).orderBy("table_name", "pos").collect():
        columns.setdefault(r.table_name, []).append(r.column_name)
    assert columns == {"users": ["id", "name", "mail"], "orders": ["z", "y"], "one_line": ["a"]}


def test_index_row(spark):
    row = sch.schema_index(_one(spark, SHOP)).first()
    assert row.num_tables == 4 and row.content_length == len(SHOP)
    assert row.has_pragma and row.has_primary_keys and row.has_foreign_keys
    assert [tuple(f) for f in row.foreign_keys] == [("user_id", "users", "id")]
    assert [t.name for t in row.table_columns] == ["one_line", "orders", "users"]


def test_tables_with_the_same_edge(spark):
    ddl = "".join(f"CREATE TABLE {t} (\nid int,\nFOREIGN KEY (user_id) REFERENCES users(id)\n);\n" for t in ("reviews", "orders"))
    ddl = "ALTER TABLE x ADD FOREIGN KEY (user_id) REFERENCES users(id);\n" + ddl
    rows = sch.schema_foreign_keys(_one(spark, ddl)).orderBy("pos").collect()
    assert [(r.pos, r.source_table) for r in rows] == [(0, None), (1, "reviews"), (2, "orders")]
    assert {(r.column, r.references_table, r.references_column) for r in rows} == {("user_id", "users", "id")}


def test_foreign_keys_with_source(spark):
    rows = sch.schema_foreign_keys(_one(spark, SHOP), inline=True).collect()
    assert {(r.source_table, r.column, r.references_table, r.references_column, r.kind) for r in rows} == {
        ("orders", "user_id", "users", "id", "table"),
        ("orders", "user_id", "users", "id", "inline"),
    }


def test_fifteen_tables(spark):
    ddl = "".join(f'CREATE TABLE "t{i}" (\n"id" int,\nprimary key("id")\n);\n' for i in range(15))
    row = sch.schema_index(_one(spark, ddl)).first()
    assert row.num_tables == 15 and len(row.table_columns) == 15


def test_ddl_check(evaluate):
    texts = [
        "", None, "  \n", "PRAGMA foreign_keys = ON;", 'CREATE TABLE "u" (\n"id" int\n);',
        "PRAGMA x;\nCREATE TABLE u (id int);", "create\ttable u (id int",
    ]
    assert evaluate(d.ddl_is_valid, texts) == [False, False, False, False, True, True, True]
    assert evaluate(d.ddl_warnings, texts) == [
        [fv.SCHEMA_EMPTY], [fv.SCHEMA_EMPTY], [fv.SCHEMA_EMPTY], [fv.SCHEMA_NO_TABLE], [fv.SCHEMA_NO_PRAGMA], [],
        [fv.SCHEMA_NO_PRAGMA, "Unbalanced parentheses: 1 open, 0 close", fv.SCHEMA_NO_SEMICOLON],
    ]


REWRITE = [
    ("PRAGMA foreign_keys = ON;\nCREATE TABLE users (id int);", "CREATE TABLE users (id int);"),
    ("BEGIN TRANSACTION;\nCREATE TABLE users (id int);\nCOMMIT;", "CREATE TABLE users (id int);"),
    (
        'CREATE TABLE users ("id" INTEGER PRIMARY KEY AUTOINCREMENT, "name" TEXT);',
        'CREATE TABLE users ("id" SERIAL PRIMARY KEY, "name" TEXT);',
    ),
    ("x INTEGER  AUTOINCREMENT,", "x SERIAL,"),
    ('"data" BLOB, blobs int', '"data" BYTEA, blobs int'),
    ('"value" real, realm int', '"value" DOUBLE PRECISION, realm int'),
    (
        "\"created_at\" DATETIME DEFAULT DATETIME('now')",
        '"created_at" TIMESTAMP DEFAULT CURRENT_TIMESTAMP',
    ),
    ("a\n\n\n\nb\n\nc\n", "a\n\nb\n\nc"),
    ("a\nCOMMIT WORK;\n commit ;\nb", "a\nCOMMIT WORK;\nb"),
    ("PRAGMA\nx", "PRAGMA\nx"),
    ("INTEGER\nAUTOINCREMENT", "INTEGER\nAUTOINCREMENT"),
    ("x\nPRAGMA a\nPRAGMA b\nCOMMIT", "x"),
    ("", ""),
    (None, None),
]


def test_rewrite_ddl(evaluate):
    assert evaluate(dl.rewrite_ddl, [c for c, _ in REWRITE]) == [e for _, e in REWRITE]


def test_rewrite_ddl_is_idempotent(evaluate):
    once = evaluate(dl.rewrite_ddl, [c for c, _ in REWRITE])
    assert evaluate(dl.rewrite_ddl, once) == once


def test_line_counters(spark):
    ddl = "PRAGMA a;\nx BLOB, y BLOB\nREAL\nreal, REAL\nBEGIN TRANSACTION\nINTEGER AUTOINCREMENT, INTEGER PRIMARY KEY AUTOINCREMENT\ncommit;\nPRAGMA blob REAL"
    hits = dl.ddl_rule_hits(F.col("ddl"))
    row = _one(spark, ddl).select(*[c.alias(n) for n, c in hits.items()]).first().asDict()
    assert row == {
        "autoincrement_to_serial": 2, "pragma_removals": 2, "begin_transaction_removals": 1, "commit_removals": 1,
        "blob_to_bytea": 1, "real_to_numeric": 2, "datetime_type": 0,
    }


def test_drop_inserts(evaluate):
    text = "CREATE TABLE t (a int);\nINSERT INTO t VALUES ('REAL');\n insert into t values (1);\nx"
    assert evaluate(dl.drop_inserts, [text]) == ["CREATE TABLE t (a int);\nx"]


def test_index_statistics_and_missing(spark):
    rows = [("a", SHOP), ("b", None), ("c", "CREATE TABLE t (\n" * 6), ("d", "CREATE TABLE t (" * 11)]
    row = sch.index_statistics(spark.createDataFrame(rows, "db_id string, ddl string")).first()
    assert (row.total_found, row.successfully_parsed, row.missing_schema) == (4, 3, 1)
    assert (row.databases_lt_5_tables, row.databases_5_to_10_tables, row.databases_gt_10_tables) == (1, 1, 1)
    assert row.databases_with_foreign_keys == 1


def test_cross_reference(spark):
    schemas = spark.createDataFrame([("a", SHOP), ("b", "CREATE TABLE Q (x int);")], "db_id string, ddl string")
    catalogue = spark.createDataFrame(
        [("a", ["USERS", "Orders", "ghost"]), ("c", ["x"])], "db_id string, table_names_original array<string>"
    )
    rows = {r.db_id: r for r in sch.cross_reference(schemas, catalogue).collect()}
    assert (rows["a"].status, rows["a"].missing, rows["a"].extra) == ("matched", ["ghost"], ["one_line"])
    assert (rows["b"].status, rows["c"].status) == ("index only", "catalogue only")
    summary = sch.cross_reference_summary(sch.cross_reference(schemas, catalogue)).first()
    assert summary.match_rate == 50.0 and summary.table_mismatches == 1


def test_catalogue_rules(spark):
    good = "CREATE TABLE t (id SERIAL PRIMARY KEY, u int REFERENCES u(id));"
    rows = spark.createDataFrame([("good", good), ("bad", "PRAGMA x; AUTOINCREMENT"), ("none", None)], "db_id string, ddl string")
    found = {(r.db_id, r.finding) for r in sch.catalogue_check(rows).collect()}
    assert {f for db, f in found if db == "bad"} == {m for _, m in fv.CATALOGUE_FORBIDDEN + fv.CATALOGUE_REQUIRED}
    assert ("none", "File not found") in found and not any(db == "good" for db, _ in found)


def test_questions_of_unknown_schema(spark):
    rows = spark.createDataFrame([("shop", ["q1", "q2"])], "name string, sample_questions array<string>")
    assert [r.question for r in sch.catalogue_questions(rows, "shop").orderBy("pos").collect()] == ["q1", "q2"]
    assert sch.catalogue_questions(rows, "nope").count() == 0


def test_rewrite_growth_is_bounded(evaluate):
    from sqlcorpus.operators.rewrite import GROWTH

    texts = ["REAL", "real REAL\nREAL", "DATETIME DEFAULT DATETIME('now')", "BLOB", "x INTEGER AUTOINCREMENT", "PRAGMA x"]
    assert all(len(new) <= GROWTH * len(old) for old, new in zip(texts, evaluate(dl.rewrite_ddl, texts)))
