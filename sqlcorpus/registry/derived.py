"""Views derived from the given tables, as column expressions both engines understand.

The given tables hold no SQL text, so the text-to-SQL corpus is derived from them. It grows with the
tables: one example per order, one database per customer. More than a third of the examples belong to
one database (``db_1``), and the DDL file of every 25th database is missing (null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


DB_OF_ORDER = "CASE WHEN o_orderkey % 20 < 7 THEN 'db_1' ELSE concat('db_', cast(o_custkey AS string)) END"

QUERY_OF_ORDER = """CASE cast(o_orderkey % 9 AS int)
    WHEN 0 THEN concat('SELECT  * FROM orders WHERE id = ', cast(o_orderkey % 4995 AS string))
    WHEN 1 THEN concat('SELECT c.name, COUNT(*) FROM c JOIN o ON c.id = o.cid GROUP BY c.name HAVING COUNT(*) > ', cast(o_custkey % 7 AS string))
    WHEN 2 THEN 'SELECT SUBSTR(name, 1, 3), substr( code ,2,5) FROM t ;'
    WHEN 3 THEN 'SELECT a FROM t WHERE id IN (SELECT id FROM u JOIN v ON u.k = v.k) EXCEPT SELECT a FROM w;'
    WHEN 4 THEN concat('select n from t where d > datetime(''now'', ''-', cast(o_custkey % 30 + 1 AS string), ' day'') and e < DATE(''now'')')
    WHEN 5 THEN 'SELECT strftime(''%Y-%m'', d), strftime(''%H:%M'', e) FROM t LEFT JOIN s ON t.i = s.i'
    WHEN 6 THEN 'SELECT MAX(x) FROM (SELECT y, COUNT(*) AS x FROM t GROUP BY y) ORDER BY MAX(x) DESC LIMIT 3'
    WHEN 7 THEN '   '
    ELSE concat('SELECT first || last FROM p WHERE age BETWEEN 1 AND ', cast(o_custkey % 90 AS string), ' UNION SELECT z FROM q')
  END"""

DDL_OF_CUSTOMER = """concat(
    CASE WHEN c_custkey % 2 = 0 THEN concat('PRAGMA foreign_keys = ON;', chr(10), 'BEGIN TRANSACTION;', chr(10)) ELSE '' END,
    'CREATE TABLE "parent_', cast(c_custkey AS string), '" (', chr(10),
    '"id" INTEGER PRIMARY KEY AUTOINCREMENT,', chr(10), '"score" REAL,', chr(10), '"made" DATETIME DEFAULT DATETIME(''now''),', chr(10),
    'unique_code text,', chr(10), 'PRIMARY KEY ("id")', chr(10), ');', chr(10), chr(10), chr(10), chr(10),
    'create table if not exists child (', chr(10), '"cid" int,', chr(10), '"pid" int,', chr(10), '"raw" BLOB,', chr(10),
    'FOREIGN KEY ("pid") REFERENCES "parent_', cast(c_custkey AS string), '"("id")', chr(10), ');', chr(10),
    CASE WHEN c_custkey % 3 = 0 THEN concat('CREATE TABLE one_line (a int, b int);', chr(10)) ELSE '' END,
    repeat(concat('CREATE TABLE extra (', chr(10), '"e" REAL,', chr(10), '"f" int', chr(10), ');', chr(10)), cast(c_custkey % 13 AS int)),
    CASE WHEN c_custkey % 7 = 0 THEN concat('INSERT INTO child VALUES (1, 2, ''real'');', chr(10)) ELSE '' END,
    CASE WHEN c_custkey % 2 = 0 THEN concat('COMMIT;', chr(10)) ELSE '' END)"""

RAW_LINE_OF_ORDER = """concat('{"question": "How many items has order ', cast(o_orderkey AS string), ' ?"',
    CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE ', "query": "SELECT 1"' END,
    CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN ', "db_id": null' ELSE ', "db_id": "d"' END, '}')"""

CHAT_LINE_OF_ORDER = """CASE
    WHEN o_orderkey % 17 = 0 THEN '{"messages": ['
    WHEN o_orderkey % 19 = 0 THEN '{"dialog": []}'
    WHEN o_orderkey % 23 = 0 THEN '{"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}'
    ELSE concat('{"messages": [{"role": "system", "content": "s"}, {"role": "',
      CASE WHEN o_orderkey % 29 = 0 THEN 'assistant' ELSE 'user' END, '", "content": "Database: d ',
      CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'Schema: ' END,
      CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE 'CREATE TABLE t (id int); ' END, 'Question: ', cast(o_orderkey AS string),
      '"}, {"role": "assistant"', CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE ', "content": "SELECT 1;"' END, '}]}')
  END"""

# columns of the given tables that are read here; stated, so that no read starts a schema job
COLUMNS = {
    "orders": "o_orderkey bigint, o_custkey bigint",
    "customer": "c_custkey bigint, c_name string, c_mktsegment string",
    "supplier": "s_suppkey bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# view -> (source table, {column: expression}); every view keeps all rows of its table
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "examples": (
        "orders",
        {
            "id": "o_orderkey",
            "db_id": DB_OF_ORDER,
            "question": "concat('How many items has order ', cast(o_orderkey % 4995 AS string), ' ?')",
            "query": QUERY_OF_ORDER,
            "source": "CASE WHEN o_orderkey % 10 = 0 THEN 'dev' ELSE 'train' END",
        },
    ),
    "schema_files": (
        "customer",
        {
            "db_id": "concat('db_', cast(c_custkey AS string))",
            "ddl": f"CASE WHEN c_custkey % 25 = 24 THEN NULL ELSE {DDL_OF_CUSTOMER} END",
        },
    ),
    "listed_tables": (
        "customer",
        {
            "db_id": "concat(CASE WHEN c_custkey % 50 = 1 THEN 'old_' ELSE 'db_' END, cast(c_custkey AS string))",
            "t1": "concat('PARENT_', cast(c_custkey AS string))",
            "t2": "CASE WHEN c_custkey % 5 = 0 THEN 'ghost' ELSE 'child' END",
            "t3": "CASE WHEN c_custkey % 13 > 0 THEN 'Extra' ELSE 'child' END",
        },
    ),
    "predictions": (
        "orders",
        {
            "id": "o_orderkey",
            "generated": f"""CASE cast(o_orderkey % 4 AS int)
    WHEN 0 THEN concat('[INST] q [/INST] ', lower({QUERY_OF_ORDER}), ' ;</s>')
    WHEN 1 THEN {QUERY_OF_ORDER}
    WHEN 2 THEN concat({QUERY_OF_ORDER}, ' LIMIT 1')
    ELSE NULL END""",
        },
    ),
    "trainlog": (
        "events",
        {
            "run_id": "CASE WHEN event_id % 20 < 7 THEN 0 ELSE user_id END",
            "step": "event_id",
            "ts": "ts",
            "loss": "CASE WHEN event_id % 37 = 0 THEN NULL ELSE value / cast(100 AS double) + 3 / (1 + event_id / cast(50 AS double)) END",
        },
    ),
    "json_lines": (
        "events",
        {
            "event_id": "event_id",
            "line": "CASE WHEN event_id % 17 = 0 THEN substr(props, 1, length(props) - 1) WHEN event_id % 23 = 0 THEN '   ' ELSE props END",
        },
    ),
    "raw_lines": ("orders", {"id": "o_orderkey", "line": RAW_LINE_OF_ORDER}),
    "chat_lines": ("orders", {"id": "o_orderkey", "line": CHAT_LINE_OF_ORDER}),
    "supplier_ddl": (
        "supplier",
        {
            "db_id": "concat('shop ', cast(s_suppkey AS string))",
            "ddl": "concat('CREATE TABLE s', cast(s_suppkey AS string), ' (', chr(10), 'id int', chr(10), ');')",
        },
    ),
    "db_files": (
        "customer",
        {
            "db_id": "concat('db_', cast(c_custkey % 500 AS string))",
            "path": "concat('/db_', cast(c_custkey % 500 AS string), '/', cast(c_custkey AS string), CASE WHEN c_custkey % 3 = 0 AND c_custkey % 500 % 7 > 0 THEN '.sqlite' ELSE '.sql' END)",
        },
    ),
    "demo_catalogue": (
        "customer",
        {
            "name": "concat('demo_', cast(c_custkey AS string))",
            "q1": "concat('List customers of ', c_mktsegment)",
            "q2": "concat('Show the balance of ', c_name)",
        },
    ),
}

# views of a few bytes a row whose texts take long to make and to work on: their rows are dealt out before the texts are made
SPREAD = {"schema_files", "examples"}


def spread(rows: DataFrame) -> DataFrame:
    """The same rows over all cores. A file is read by one task a row group, however much is then done to a row."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(COLUMNS[name]).parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    rows = table(spark, sf_dir, source)
    if name in SPREAD:
        rows = spread(rows)
    return rows.selectExpr(*[f"{expression} AS {column}" for column, expression in columns.items()])


def schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Databases whose DDL file exists."""
    return view(spark, sf_dir, "schema_files").where("ddl IS NOT NULL")


def cte(name: str) -> str:
    """The same view as a DuckDB common table expression."""
    source, columns = VIEWS[name]
    body = ",\n  ".join(f"{expression} AS {column}" for column, expression in columns.items())
    return f"{name} AS (SELECT {body} FROM {source})"
