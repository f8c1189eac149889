"""Every constant that decides a result, in one place.

Patterns are written in the plain notation ``\\s \\w \\d \\b``; ``functions.text.regex`` turns
them into explicit Unicode classes for Spark, so that results do not depend on engine defaults.
"""

# --------------------------------------------------------------------------------------------
# FIXED VALUES: white space (all characters a Unicode-aware ``split()`` separates on)
# --------------------------------------------------------------------------------------------
WHITE_SPACE = "".join(
    chr(code)
    for code in [
        9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197,
        8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288,
    ]
)

# --------------------------------------------------------------------------------------------
# FIXED VALUES: raw examples
# --------------------------------------------------------------------------------------------
REQUIRED_FILES = ["train_spider.json", "train_others.json", "dev.json", "tables.json"]
REQUIRED_FIELDS = ["question", "query", "db_id"]
MIN_DATABASES = 140

SQL_KEYWORDS = [
    "SELECT", "JOIN", "LEFT JOIN", "RIGHT JOIN", "INNER JOIN", "GROUP BY", "ORDER BY", "HAVING",
    "WHERE", "DISTINCT", "COUNT", "SUM", "AVG", "MAX", "MIN", "LIMIT", "UNION", "INTERSECT",
    "EXCEPT", "LIKE", "IN", "EXISTS", "BETWEEN", "CASE", "SUBQUERY",
]

# --------------------------------------------------------------------------------------------
# FIXED VALUES: chat examples and model prompts
# --------------------------------------------------------------------------------------------
SYSTEM_PROMPT = (
    "You are an expert PostgreSQL query generator. Given a database schema and a natural "
    "language question, generate a valid SQL query."
)
USER_PARTS = ("Database: ", "\n\nSchema:\n", "\n\nQuestion: ", "\n\nGenerate the SQL query:")
SCHEMA_MARK = "Schema:\n"
QUESTION_MARK = "\n\nQuestion:"
ANSWER_MARK = "\n\nGenerate the SQL query:"
DATABASE_MARK = "Database:"
ROLES = ["system", "user", "assistant"]

INSTRUCTION_OPEN = "<s>[INST] "
INSTRUCTION_CLOSE = " [/INST]"
END_OF_TEXT = "</s>"
DEMO_PROMPT = (
    "<s>[INST] You are a SQL expert. Given the following PostgreSQL database schema, write a SQL "
    "query that answers the user's question.\n\nDatabase Schema:\n",
    "\n\nQuestion: ",
    "\n\nGenerate only the SQL query without any explanation. [/INST]",
)
DEMO_NO_SCHEMA = "Error: Please provide a database schema."
DEMO_NO_QUESTION = "Error: Please provide a question."
MAX_SEQUENCE = 2048

# --------------------------------------------------------------------------------------------
# FIXED VALUES: patterns found in DDL text (all case-insensitive)
# --------------------------------------------------------------------------------------------
TABLE_HEAD = r"""CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?["'`]?(\w+)["'`]?\s*\("""
TABLE_BLOCK = TABLE_HEAD + r"""(.*?)\);"""  # the dot also matches newlines
CONSTRAINT_LINE = r"""^\s*(?:primary\s+key|foreign\s+key|unique|check|constraint)"""
COLUMN_HEAD = r"""^["'`]?(\w+)["'`]?\s+"""
FOREIGN_KEY = (
    r"""foreign\s+key\s*\(["'`]?(\w+)["'`]?\)\s*"""
    r"""references\s+["'`]?(\w+)["'`]?\s*\(["'`]?(\w+)["'`]?\)"""
)
INLINE_REFERENCE = r"""\breferences\s+["'`]?(\w+)["'`]?\s*\(["'`]?(\w+)["'`]?\)"""
HAS_FOREIGN_KEY = r"foreign\s+key"
HAS_PRIMARY_KEY = r"primary\s+key"
HAS_CREATE_TABLE = r"CREATE\s+TABLE"

SCHEMA_EMPTY = "Schema content is empty"
SCHEMA_NO_TABLE = "No CREATE TABLE statement found"
SCHEMA_NO_PRAGMA = "Schema does not start with PRAGMA statement"
SCHEMA_NO_SEMICOLON = "No semicolons found - statements may be incomplete"

# --------------------------------------------------------------------------------------------
# FIXED VALUES: SQLite to PostgreSQL, query text (case-insensitive)
# --------------------------------------------------------------------------------------------
NOW = r"""\s*\(\s*['"]now['"]\s*"""
DATETIME_NOW = r"\bDATETIME" + NOW + r"\)"
DATETIME_OFFSET = (
    r"\bDATETIME" + NOW + r""",\s*['"]([+-]?\d+)\s*"""
    r"""(day|days|hour|hours|minute|minutes|second|seconds)['"]\s*\)"""
)
OFFSET_UNITS = ["day", "hour", "minute", "second"]
DATE_NOW = r"\bDATE" + NOW + r"\)"
TIME_NOW = r"\bTIME" + NOW + r"\)"
STRFTIME = r"""\bstrftime\s*\(\s*['"]([^'"]+)['"]\s*,\s*([^)]+)\)"""
STRFTIME_FORMATS = [
    ("%Y", "YYYY"), ("%m", "MM"), ("%d", "DD"), ("%H", "HH24"), ("%M", "MI"), ("%S", "SS"),
]
SUBSTR = r"\bSUBSTR\s*\(\s*([^,]+?)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)"

# --------------------------------------------------------------------------------------------
# FIXED VALUES: SQLite to PostgreSQL, DDL text (applied inside single lines, case-insensitive)
# --------------------------------------------------------------------------------------------
PRAGMA_LINE = r"^\s*PRAGMA\s+[^\n]*"
BEGIN_LINE = r"^\s*BEGIN\s+TRANSACTION\s*;?\s*$"
COMMIT_LINE = r"^\s*COMMIT\s*;?\s*$"
AUTOINCREMENT_KEY = r"INTEGER\s+PRIMARY\s+KEY\s+AUTOINCREMENT"
AUTOINCREMENT = r"INTEGER\s+AUTOINCREMENT"
BLOB = r"\bBLOB\b"
REAL = r"\bREAL\b"
DEFAULT_DATETIME_NOW = r"DEFAULT\s+DATETIME" + NOW + r"\)"
DATETIME_TYPE = r"\bDATETIME\b"
INSERT_LINE = r"^\s*INSERT\s+INTO\s+[^\n]*"

# --------------------------------------------------------------------------------------------
# FIXED VALUES: pattern detection and residue check (case-insensitive)
# --------------------------------------------------------------------------------------------
DETECTED = {
    "datetime_now": r"""DATETIME\s*\(\s*['"]now""",
    "date_now": r"""DATE\s*\(\s*['"]now""",
    "time_now": r"""TIME\s*\(\s*['"]now""",
    "strftime": r"strftime\s*\(",
    "substr": r"SUBSTR\s*\(",
    "autoincrement": r"AUTOINCREMENT",
    "pragma": r"PRAGMA\s+",
}
RESIDUE = [
    (r"""DATETIME\s*\(\s*['"]now""", "DATETIME('now') not converted"),
    (r"""DATE\s*\(\s*['"]now""", "DATE('now') not converted"),
    (r"""TIME\s*\(\s*['"]now""", "TIME('now') not converted"),
    (r"\bAUTOINCREMENT\b", "AUTOINCREMENT not converted"),
    (r"^\s*PRAGMA\s+", "PRAGMA statement not removed"),
]

# --------------------------------------------------------------------------------------------
# FIXED VALUES: query features (substrings of the upper-cased text)
# --------------------------------------------------------------------------------------------
FEATURE_WORDS = {
    "has_insert": ["INSERT"],
    "has_update": ["UPDATE"],
    "has_delete": ["DELETE"],
    "has_join": ["JOIN"],
    "has_inner_join": ["INNER JOIN"],
    "has_left_join": ["LEFT JOIN", "LEFT OUTER JOIN"],
    "has_right_join": ["RIGHT JOIN", "RIGHT OUTER JOIN"],
    "has_full_join": ["FULL JOIN", "FULL OUTER JOIN"],
    "has_cross_join": ["CROSS JOIN"],
    "has_where": ["WHERE"],
    "has_group_by": ["GROUP BY"],
    "has_having": ["HAVING"],
    "has_order_by": ["ORDER BY"],
    "has_limit": ["LIMIT"],
    "has_union": ["UNION"],
    "has_except": ["EXCEPT"],
    "has_intersect": ["INTERSECT"],
    "has_count": ["COUNT("],
    "has_sum": ["SUM("],
    "has_avg": ["AVG("],
    "has_max": ["MAX("],
    "has_min": ["MIN("],
    "has_aggregation": ["COUNT(", "SUM(", "AVG(", "MAX(", "MIN("],
    "has_distinct": ["DISTINCT"],
    "has_like": ["LIKE"],
    "has_in": [" IN ", " IN("],
    "has_between": ["BETWEEN"],
    "has_case": ["CASE "],
    "has_null_check": ["IS NULL", "IS NOT NULL"],
}
JOIN_WORD = r"\bJOIN\b"
FROM_WORD = r"\bFROM\b"
CLASS_LABELS = {1: "simple", 2: "medium", 3: "complex", 4: "very_complex"}
UNKNOWN_LABEL = "unknown"

# --------------------------------------------------------------------------------------------
# FIXED VALUES: splits, scoring, training log, catalogue rules
# --------------------------------------------------------------------------------------------
SEED = 42
SPLIT_RATIO = 0.5
MAX_DRIFT_POINTS = 5
EVAL_SAMPLES = 50
PROMPT_PREVIEW = 200
REPORT_ROWS = 10
PATIENCE = 3
MIN_DELTA = 0.01
CATALOGUE_FORBIDDEN = [
    ("AUTOINCREMENT", "Contains AUTOINCREMENT (SQLite)"),
    ("PRAGMA", "Contains PRAGMA (SQLite)"),
]
CATALOGUE_REQUIRED = [
    ("SERIAL", "Missing SERIAL for auto-increment"),
    ("REFERENCES", "Missing foreign key REFERENCES"),
    ("CREATE TABLE", "Missing CREATE TABLE statements"),
]
