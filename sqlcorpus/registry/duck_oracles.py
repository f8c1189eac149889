"""DuckDB twins of the registered queries.

They follow the definitions in the plainest way (per-line lists, per-example joins, sorted lists,
recursive walks), so that they check the Spark plans and do not repeat them.
"""

from __future__ import annotations

from sqlcorpus import fixed_values as fv
from sqlcorpus.registry.derived import VIEWS, cte

ORACLES: dict[str, str] = {}


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def nl(text: str) -> str:
    """A SQL string expression for text with newlines."""
    return "concat(" + ", chr(10), ".join(q(part) for part in text.split("\n")) + ")"


def with_(*views: str, body: str) -> str:
    parts = []
    for v in views:
        if v == "schemas":
            parts += [cte("schema_files"), "schemas AS (SELECT * FROM schema_files WHERE ddl IS NOT NULL)"]
        else:
            parts.append(cte(v) if v in VIEWS else _EXTRA[v])
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def sub(col: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({col}, {q(pattern)}, {q(replacement)}, 'gi')"


def has(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)}, 'i')"


def collapsed(col: str) -> str:
    return f"trim(regexp_replace({col}, '\\s+', ' ', 'g'))"


def stripped(col: str) -> str:
    return f"regexp_replace(regexp_replace({col}, '^\\s+', ''), '\\s+$', '')"


def clean(col: str) -> str:
    c = collapsed(col)
    return f"CASE WHEN coalesce({col}, '') = '' THEN '' WHEN ends_with({c}, ';') THEN {c} ELSE concat({c}, ';') END"


def is_blank(col: str) -> str:
    return f"({stripped(col)} = '')"


def pg_query(col: str) -> str:
    out = sub(col, fv.DATETIME_NOW, "CURRENT_TIMESTAMP")
    for unit in fv.OFFSET_UNITS:
        for sign, digits in (("-", r"-(\d+)"), ("+", r"\+?(\d+)")):
            pattern = r"\bDATETIME" + fv.NOW + r""",\s*['"]""" + digits + rf"""\s*{unit}s?['"]\s*\)"""
            out = sub(out, pattern, rf"CURRENT_TIMESTAMP {sign} INTERVAL '\1 {unit.upper()}S'")
    out = sub(out, fv.DATE_NOW, "CURRENT_DATE")
    out = sub(out, fv.TIME_NOW, "CURRENT_TIME")
    return out


# every call is rebuilt from its own arguments: gaps[i] || call[i]
_FMT = "f[i]"
for _theirs, _ours in fv.STRFTIME_FORMATS:
    _FMT = f"replace({_FMT}, {q(_theirs)}, {q(_ours)})"
_STRFTIME = "(?i)" + fv.STRFTIME


def pg_sql_cte(name: str, source: str, sql_col: str = "sql") -> str:
    """All columns of ``source`` plus ``pg_sql``."""
    joined = (
        "array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: concat(gaps[i], CASE WHEN i <= len(f) "
        f"THEN concat('TO_CHAR(', trim(e[i]), ', ''', {_FMT}, ''')') ELSE '' END)), '')"
    )
    substr = sub("_s", fv.SUBSTR, r"SUBSTRING(\1 FROM \2 FOR \3)")
    return f"""{name}_q AS (SELECT *, {pg_query(sql_col)} AS _q FROM {source}),
{name}_c AS (SELECT *, string_split_regex(_q, {q(_STRFTIME)}) AS gaps,
  regexp_extract_all(_q, {q(_STRFTIME)}, 1) AS f, regexp_extract_all(_q, {q(_STRFTIME)}, 2) AS e FROM {name}_q),
{name}_s AS (SELECT *, {joined} AS _s FROM {name}_c),
{name} AS (SELECT * EXCLUDE (_q, gaps, f, e, _s), {substr} AS pg_sql FROM {name}_s)"""


_KEPT = (
    "list_filter(string_split(ddl, chr(10)), lambda l: NOT regexp_matches(l, {p}, 'i') "
    "AND NOT regexp_matches(l, {b}, 'i') AND NOT regexp_matches(l, {c}, 'i'))"
).format(p=q(r"^\s*PRAGMA\s+"), b=q(fv.BEGIN_LINE), c=q(fv.COMMIT_LINE))
_LINE = "l"
for _pattern, _new in (
    (fv.AUTOINCREMENT_KEY, "SERIAL PRIMARY KEY"),
    (fv.AUTOINCREMENT, "SERIAL"),
    (fv.BLOB, "BYTEA"),
    (fv.REAL, "DOUBLE PRECISION"),
    (fv.DEFAULT_DATETIME_NOW, "DEFAULT CURRENT_TIMESTAMP"),
    (fv.DATETIME_TYPE, "TIMESTAMP"),
):
    _LINE = sub(_LINE, _pattern, _new)


def pg_ddl(kept: str = _KEPT) -> str:
    lines = f"array_to_string(list_transform({kept}, lambda l: {_LINE}), chr(10))"
    return stripped(f"regexp_replace({lines}, '\\n{{3,}}', concat(chr(10), chr(10)), 'g')")


def lines_with(pattern: str, lines: str = _KEPT) -> str:
    return f"len(list_filter({lines}, lambda l: regexp_matches(l, {q(pattern)}, 'i')))"


_ALL_LINES = "string_split(ddl, chr(10))"
_LINE_HITS = {
    "autoincrement_to_serial": f"{lines_with(fv.AUTOINCREMENT_KEY)} + {lines_with(fv.AUTOINCREMENT)}",
    "pragma_removals": lines_with(r"^\s*PRAGMA\s+", _ALL_LINES),
    "begin_transaction_removals": lines_with(fv.BEGIN_LINE, _ALL_LINES),
    "commit_removals": lines_with(fv.COMMIT_LINE, _ALL_LINES),
    "blob_to_bytea": lines_with(fv.BLOB),
    "real_to_numeric": lines_with(fv.REAL),
    "datetime_type": lines_with(fv.DATETIME_TYPE),
}
_FLAT_NOW = sub("sql", fv.DATETIME_NOW, "CURRENT_TIMESTAMP")
_QUERY_HITS = {
    "datetime_now": f"cast({has('sql', fv.DATETIME_NOW)} AS int) + cast({has(_FLAT_NOW, fv.DATETIME_OFFSET)} AS int)",
    "date_now": f"cast({has('sql', fv.DATE_NOW)} AS int)",
    "time_now": f"cast({has('sql', fv.TIME_NOW)} AS int)",
    "strftime": f"cast({has('sql', fv.STRFTIME)} AS int)",
    "substr": f"cast({has('sql', fv.SUBSTR)} AS int)",
    "concatenation_operators": "cast(contains(sql, '||') AS int)",
}

_USER = f"concat('Database: ', db_id, {nl(fv.USER_PARTS[1])}, {{ddl}}, {nl(fv.USER_PARTS[2])}, question, {nl(fv.USER_PARTS[3])})"


def user(ddl: str) -> str:
    return _USER.format(ddl=ddl)


def flag(words: list[str], u: str = "u") -> str:
    return "(" + " OR ".join(f"contains({u}, {q(w)})" for w in words) + ")"


_SELECTS = "(length(u) - length(replace(u, 'SELECT', ''))) // 6"
_JOINS = "len(regexp_extract_all(u, '\\bJOIN\\b'))"
_FLAGS = {"has_select": "(starts_with(u, 'SELECT') OR contains(u, ' SELECT '))"}
_FLAGS.update({name: flag(words) for name, words in fv.FEATURE_WORDS.items()})
_FLAGS["has_subquery"] = f"({_SELECTS} > 1)"
_AGG, _GROUP, _JOIN = (_FLAGS[f] for f in ("has_aggregation", "has_group_by", "has_join"))
_SET_OP = flag(["UNION", "EXCEPT", "INTERSECT"])
_LEVEL = f"""greatest(
  CASE WHEN {_SELECTS} - 1 >= 2 OR ({_SELECTS} > 1 AND {_AGG} AND {_GROUP}) THEN 4
       WHEN {_SELECTS} > 1 OR {_JOINS} >= 2 THEN 3 WHEN {_JOIN} OR {_GROUP} THEN 2 ELSE 1 END,
  CASE WHEN {_SET_OP} THEN 3 ELSE 1 END)"""
_LABEL = "CASE level WHEN 1 THEN 'simple' WHEN 2 THEN 'medium' WHEN 3 THEN 'complex' WHEN 4 THEN 'very_complex' ELSE 'unknown' END"
_REPORT_LABEL = f"""CASE WHEN {_SELECTS} > 1 OR {_JOINS} >= 2
  THEN CASE WHEN {_SELECTS} >= 2 AND {_AGG} THEN 'very_complex' ELSE 'complex' END
  WHEN {_JOIN} OR {_GROUP} THEN 'medium' ELSE 'simple' END"""

_SPLIT_RULE = "rn <= floor(n * 0.5)"
_EXTRA = {
    "cleaned": f"cleaned AS (SELECT *, {clean('query')} AS sql FROM examples)",
    "uppered": "uppered AS (SELECT *, upper(sql) AS u FROM cleaned)",
    "usable": f"usable AS (SELECT e.*, s.ddl, {clean('query')} AS sql FROM examples e JOIN schemas s USING (db_id) WHERE NOT {is_blank('query')})",
    "chat": f"chat AS (SELECT *, {q(fv.SYSTEM_PROMPT)} AS system, {user('ddl')} AS user_text FROM usable)",
    "rewritten": pg_sql_cte("rewritten", "usable"),
    "rewritten_all": pg_sql_cte("rewritten_all", "cleaned"),
    "pg_schemas": f"pg_schemas AS (SELECT *, {pg_ddl()} AS pg_ddl FROM schemas)",
    "levelled": f"levelled AS (SELECT *, {_LEVEL} AS level FROM uppered)",
    "labelled": f"labelled AS (SELECT *, {_LABEL} AS label FROM levelled)",
    "ranked": """ranked AS (SELECT id, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', cast(id AS string))), id) AS rn,
  count(*) OVER (PARTITION BY label) AS n FROM labelled WHERE source = 'dev')""",
    "split": f"""split AS (SELECT l.*, CASE WHEN l.source = 'train' THEN 'train' WHEN {_SPLIT_RULE} THEN 'validation' ELSE 'test' END AS split
  FROM labelled l LEFT JOIN ranked r USING (id))""",
    "ids": "ids AS (SELECT DISTINCT split, question, sql FROM split)",
    "overlap": """overlap AS (SELECT
  (SELECT count(*) FROM (SELECT question, sql FROM ids WHERE split = 'train' INTERSECT SELECT question, sql FROM ids WHERE split = 'validation')) AS tv,
  (SELECT count(*) FROM (SELECT question, sql FROM ids WHERE split = 'train' INTERSECT SELECT question, sql FROM ids WHERE split = 'test')) AS tt,
  (SELECT count(*) FROM (SELECT question, sql FROM ids WHERE split = 'validation' INTERSECT SELECT question, sql FROM ids WHERE split = 'test')) AS vt)""",
    "shares": """shares AS (SELECT split, label, count(*) / sum(count(*)) OVER (PARTITION BY split) AS share
  FROM split WHERE split <> 'train' GROUP BY split, label)""",
    "drift": """drift AS (SELECT coalesce(max(abs(coalesce(v.share, 0) * 100 - coalesce(t.share, 0) * 100)), 0) AS max_diff
  FROM (SELECT * FROM shares WHERE split = 'validation') v FULL JOIN (SELECT * FROM shares WHERE split = 'test') t USING (label))""",
    "catalogue": """catalogue AS (SELECT db_id, list_distinct([t1, t2, t3]) AS names FROM listed_tables)""",
    "conv": """conv AS (SELECT conv_id,
  coalesce(arg_max(text, turn) FILTER (WHERE role = 'system'), '') AS system,
  coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS user_text,
  coalesce(arg_max(text, turn) FILTER (WHERE role = 'assistant'), '') AS answer FROM conversations GROUP BY conv_id)""",
    "prompts": """prompts AS (SELECT *, concat('<s>[INST] ', CASE WHEN system <> '' THEN concat(system, chr(10)) ELSE '' END, user_text, ' [/INST]') AS prompt FROM conv)""",
    "rendered": "rendered AS (SELECT *, concat(prompt, ' ', answer, '</s>') AS text FROM prompts)",
    "scored": None,  # set below
}


def n_tokens(col: str) -> str:
    return f"len(regexp_extract_all({col}, '[^\\s]+'))"


def normalised(col: str) -> str:
    return f"trim(regexp_replace({collapsed(f'lower({col})')}, ';+$', ''))"


def completion(col: str) -> str:
    tail = f"CASE WHEN contains({col}, '[/INST]') THEN string_split({col}, '[/INST]')[-1] ELSE {col} END"
    return stripped(f"replace({stripped(tail)}, '</s>', '')")


def demo_completion(col: str) -> str:
    tail = stripped(f"CASE WHEN contains({col}, '[/INST]') THEN string_split({col}, '[/INST]')[-1] ELSE {col} END")
    cut = stripped(f"string_split({tail}, '</s>')[1]")
    return stripped(f"string_split({cut}, '[INST]')[1]")


_EXTRA["scored"] = f"""scored AS (SELECT l.id, l.label, l.query AS reference, concat_ws(' ', question, question, question, question, question, question, question, question) AS prompt,
  coalesce({completion('p.generated')}, '') AS generated,
  {normalised(f"coalesce({completion('p.generated')}, '')")} = {normalised('l.query')} AS exact_match
  FROM labelled l LEFT JOIN predictions p USING (id))"""


def _bigint_counts(sql: str) -> str:
    """DuckDB's ``count_if`` is a HUGEINT; cast every call. Brackets outside quotes are matched."""
    out, at = [], 0
    while (start := sql.find("count_if(", at)) >= 0:
        end, depth, quoted = start + len("count_if("), 1, False
        while depth:
            quoted ^= sql[end] == "'"
            depth += 0 if quoted else {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += [sql[at:start], "cast(", sql[start:end], " AS bigint)"]
        at = end
    return "".join([*out, sql[at:]])


def oracle(name: str, *views: str, body: str) -> None:
    ORACLES[name] = _bigint_counts(with_(*views, body=body) if views else body)


EX, SC = "examples", "schemas"
CLEANED = (EX, "cleaned")
USABLE = (EX, SC, "usable")
LABELLED = (EX, "cleaned", "uppered", "levelled", "labelled")
SPLIT = (*LABELLED, "ranked", "split")

# ---- sources and sinks
oracle("s1_example_arrays", EX, body="SELECT id // 100 AS doc, db_id, question, query FROM examples")
oracle(
    "s1_example_files", EX,
    body="SELECT id // 5000 AS doc, count(*) AS n, cast(sum(length(query)) AS bigint) AS query_chars, min(question) AS first_question "
    "FROM examples WHERE (id // 5000) % 3 <> 2 GROUP BY 1",
)
oracle(
    "e5_source_errors", EX,
    body="SELECT DISTINCT cast(id // 5000 AS varchar) AS source, 'invalid JSON' AS error FROM examples WHERE (id // 5000) % 3 = 2 "
    "UNION ALL SELECT 'dev', 'File not found: dev'",
)
oracle("s2_jsonl_strict", *USABLE, "chat", body="SELECT system, md5(user_text) AS user_md5, sql AS assistant FROM chat")
_STATUS = f"CASE WHEN {is_blank('line')} THEN 'blank' WHEN json_valid(line) THEN 'ok' ELSE 'broken' END"
oracle("s3_jsonl_tolerant", "json_lines", body=f"SELECT event_id, {_STATUS} AS line_status FROM json_lines")
oracle(
    "s3_jsonl_tolerant_files", "json_lines",
    body=f"SELECT {_STATUS} AS side, count(*) AS n FROM json_lines WHERE {_STATUS} <> 'blank' GROUP BY 1",
)
oracle("s4_ddl_corpus", "supplier_ddl", body="SELECT db_id, ddl FROM supplier_ddl")
oracle("s5_catalogue", "listed_tables", "catalogue", body="SELECT db_id, lower(unnest(names)) AS table_name FROM catalogue")
oracle(
    "s6_write_jsonl", *CLEANED,
    body="SELECT source, count(*) AS n, cast(sum(length(sql)) AS bigint) AS sql_chars FROM cleaned GROUP BY source",
)
_TABLES = f"regexp_extract_all(ddl, {q('(?i)' + fv.TABLE_HEAD)}, 1)"
oracle(
    "s7_write_schema_index", SC,
    body=f"SELECT db_id, len({_TABLES}) AS num_tables, starts_with(upper({stripped('ddl')}), 'PRAGMA') AS has_pragma, md5(ddl) AS ddl_md5 FROM schemas",
)
oracle(
    "s8_write_reports", *CLEANED,
    body="SELECT count(*) AS total_examples, count_if(contains(upper(sql), 'JOIN')) AS with_join, "
    "round(count_if(contains(upper(sql), 'JOIN')) / count(*) * 100, 1) AS pct_with_join FROM cleaned",
)

# ---- ingest checks
oracle(
    "v1_manifest", EX,
    body="SELECT e.name, o.n IS NOT NULL AS present, round(coalesce(b, 0) / 1048576, 3) AS size_mb, coalesce(o.n, 0) AS examples, "
    "bool_and(o.n IS NOT NULL) OVER () AS all_present, cast(sum(CASE WHEN o.n IS NULL THEN 1 ELSE 0 END) OVER () AS bigint) AS n_missing FROM (VALUES ('train'), ('dev'), ('others')) e(name) "
    "LEFT JOIN (SELECT source, count(*) AS n, sum(strlen(question) + 1) AS b FROM examples GROUP BY source) o ON o.source = e.name",
)
_MISSING = "list_filter(['question', 'query', 'db_id'], lambda k: NOT list_contains(json_keys(line), k))"
oracle(
    "v2_required_fields", "raw_lines",
    body=f"""SELECT *, total - valid AS invalid, CASE WHEN valid = total THEN 'all valid' WHEN valid > 0 THEN 'some valid' ELSE 'none valid' END AS status
FROM (SELECT count(*) AS total, count_if(len({_MISSING}) = 0) AS valid FROM raw_lines)""",
)
oracle(
    "v2_first_offenders", "raw_lines",
    body=f"SELECT id, array_to_string({_MISSING}, ',') AS missing FROM raw_lines WHERE len({_MISSING}) > 0 ORDER BY id LIMIT 3",
)
_KEYWORDS = "(VALUES " + ", ".join(f"({q(k)})" for k in fv.SQL_KEYWORDS) + ") k(keyword)"
_NESTED = f"CASE WHEN keyword = 'SUBQUERY' AND {_SELECTS} > 1 THEN 1 ELSE 0 END"
oracle(
    "v3_keyword_frequency", EX,
    body=f"""SELECT keyword, n, round(n / (SELECT count(*) FROM examples) * 100, 1) AS pct FROM (
  SELECT keyword, cast(sum(cast(contains(u, keyword) AS int) + {_NESTED}) AS bigint) AS n
  FROM (SELECT upper(query) AS u FROM examples), {_KEYWORDS} GROUP BY keyword) WHERE n > 0 ORDER BY n DESC, keyword LIMIT 15""",
)
oracle(
    "v3_keyword_frequency_words", EX,
    body=f"""SELECT * FROM (SELECT keyword, cast(sum(cast(regexp_matches(u, concat('\\b', keyword, '\\b')) AS int) + {_NESTED}) AS bigint) AS n
  FROM (SELECT upper(query) AS u FROM examples), {_KEYWORDS} GROUP BY keyword) WHERE n > 0""",
)
oracle(
    "v4_database_coverage", "db_files",
    body="""SELECT count(*) AS total_dbs, count_if(ok) AS dbs_with_sqlite, count_if(ok) >= 140 AS passed
FROM (SELECT db_id, bool_or(ends_with(path, '.sqlite')) AS ok FROM db_files GROUP BY db_id)""",
)
oracle(
    "v4_databases_without_file", "db_files",
    body="SELECT db_id FROM db_files GROUP BY db_id HAVING NOT bool_or(ends_with(path, '.sqlite')) ORDER BY db_id LIMIT 5",
)

# ---- DDL
oracle(
    "d1_table_names", SC,
    body=f"SELECT db_id, i - 1 AS pos, t[i] AS table_name FROM (SELECT db_id, {_TABLES} AS t, unnest(range(1, len({_TABLES}) + 1)) AS i FROM schemas)",
)
_BLOCK = q("(?is)" + fv.TABLE_BLOCK)
oracle(
    "d2_column_names", SC,
    body=f"""SELECT db_id, table_name, i - 1 AS pos, cols[i] AS column_name FROM (
  SELECT *, unnest(range(1, len(cols) + 1)) AS i FROM (
    SELECT db_id, table_name, list_filter(list_transform(list_filter(
        list_transform(string_split(body, chr(10)), lambda l: rtrim({stripped('l')}, ',')),
        lambda l: l <> '' AND NOT regexp_matches(l, {q(fv.CONSTRAINT_LINE)}, 'i')),
        lambda l: regexp_extract(l, {q(fv.COLUMN_HEAD)}, 1)), lambda c: c <> '') AS cols
    FROM (SELECT db_id, names[j] AS table_name, bodies[j] AS body,
            row_number() OVER (PARTITION BY db_id, names[j] ORDER BY j DESC) AS last
          FROM (SELECT *, unnest(range(1, len(names) + 1)) AS j FROM (
            SELECT db_id, regexp_extract_all(ddl, {_BLOCK}, 1) AS names, regexp_extract_all(ddl, {_BLOCK}, 2) AS bodies FROM schemas)))
    WHERE last = 1))""",
)
_FK = q("(?i)" + fv.FOREIGN_KEY)
oracle(
    "d3_foreign_keys", SC,
    body=f"""SELECT db_id, c[i] AS "column", t[i] AS references_table, k[i] AS references_column, 'child' AS source_table FROM (
  SELECT *, unnest(range(1, len(c) + 1)) AS i FROM (SELECT db_id, regexp_extract_all(ddl, {_FK}, 1) AS c,
    regexp_extract_all(ddl, {_FK}, 2) AS t, regexp_extract_all(ddl, {_FK}, 3) AS k FROM schemas))""",
)
oracle(
    "d4_ddl_flags", SC,
    body=f"""SELECT db_id, {has('ddl', fv.HAS_FOREIGN_KEY)} AS has_foreign_keys, {has('ddl', fv.HAS_PRIMARY_KEY)} AS has_primary_keys,
  starts_with(upper({stripped('ddl')}), 'PRAGMA') AS has_pragma, length(ddl) AS content_length FROM schemas""",
)
_OPEN, _CLOSE = "len(string_split(d, '(')) - 1", "len(string_split(d, ')')) - 1"
oracle(
    "d5_ddl_check", SC,
    body=f"""SELECT db_id, {is_blank('d')} = false AND {has('d', fv.HAS_CREATE_TABLE)} AS is_valid,
  CASE WHEN {is_blank('d')} THEN {q(fv.SCHEMA_EMPTY)} WHEN NOT {has('d', fv.HAS_CREATE_TABLE)} THEN {q(fv.SCHEMA_NO_TABLE)}
  ELSE array_to_string(list_filter([
    CASE WHEN NOT starts_with(upper({stripped('d')}), 'PRAGMA') THEN {q(fv.SCHEMA_NO_PRAGMA)} END,
    CASE WHEN {_OPEN} <> {_CLOSE} THEN concat('Unbalanced parentheses: ', {_OPEN}, ' open, ', {_CLOSE}, ' close') END,
    CASE WHEN NOT contains(d, ';') THEN {q(fv.SCHEMA_NO_SEMICOLON)} END], lambda x: x IS NOT NULL), '|') END AS warnings
FROM (SELECT db_id, CASE WHEN length(db_id) % 3 = 0 THEN array_to_string(string_split(ddl, '(')[1:3], '(') ELSE ddl END AS d FROM schemas)""",
)
oracle(
    "d6_schema_index", SC,
    body=f"""SELECT db_id, len({_TABLES}) AS num_tables, array_to_string({_TABLES}, ',') AS tables,
  len(list_distinct(regexp_extract_all(ddl, {_BLOCK}, 1))) AS n_described, len(regexp_extract_all(ddl, {_FK}, 1)) AS n_foreign_keys,
  {has('ddl', fv.HAS_FOREIGN_KEY)} AS has_foreign_keys, {has('ddl', fv.HAS_PRIMARY_KEY)} AS has_primary_keys,
  starts_with(upper({stripped('ddl')}), 'PRAGMA') AS has_pragma, length(ddl) AS content_length FROM schemas""",
)
oracle(
    "d7_index_statistics", EX, SC,
    body=f"""SELECT count(*) AS total_found, count(ddl) AS schema_files_found, count(ddl) AS successfully_parsed, count_if(ddl IS NULL) AS missing_schema,
  cast(0 AS bigint) AS parse_errors,
  count_if(n < 5) AS databases_lt_5_tables, count_if(n BETWEEN 5 AND 10) AS databases_5_to_10_tables,
  count_if(n > 10) AS databases_gt_10_tables, count_if({has('ddl', fv.HAS_FOREIGN_KEY)}) AS databases_with_foreign_keys
FROM (SELECT db_id, ddl, len({_TABLES}) AS n FROM (SELECT DISTINCT db_id FROM examples) LEFT JOIN schemas USING (db_id))""",
)
_FOLDERS = f"""SELECT db_id, k % 5 = 2 AS missing, k % 5 <> 2 AND k % 7 = 3 AS broken, len({_TABLES}) AS n
FROM (SELECT db_id, ddl, cast(regexp_extract(db_id, '([0-9]+)$', 1) AS bigint) AS k FROM supplier_ddl)"""
oracle(
    "d6_schema_rejects", "supplier_ddl",
    body=f"SELECT db_id, CASE WHEN missing THEN 'missing schema' ELSE 'not UTF-8' END AS reason FROM ({_FOLDERS}) WHERE missing OR broken",
)
oracle(
    "d7_index_statistics_files", "supplier_ddl",
    body=f"""SELECT count(*) AS total_found, count_if(NOT missing) AS schema_files_found, count_if(NOT missing AND NOT broken) AS successfully_parsed,
  count_if(missing) AS missing_schema, count_if(broken) AS parse_errors, count_if(NOT missing AND NOT broken AND n < 5) AS databases_lt_5_tables,
  count_if(NOT missing AND NOT broken AND n BETWEEN 5 AND 10) AS databases_5_to_10_tables,
  count_if(NOT missing AND NOT broken AND n > 10) AS databases_gt_10_tables, cast(0 AS bigint) AS databases_with_foreign_keys FROM ({_FOLDERS})""",
)
_COMPARED = f"""SELECT db_id, CASE WHEN p IS NULL THEN 'catalogue only' WHEN names IS NULL THEN 'index only' ELSE 'matched' END AS status,
  CASE WHEN p IS NOT NULL AND names IS NOT NULL THEN list_sort(list_filter(list_distinct(list_transform(names, lambda x: lower(x))), lambda x: NOT list_contains(p, x))) END AS missing,
  CASE WHEN p IS NOT NULL AND names IS NOT NULL THEN list_sort(list_filter(list_distinct(p), lambda x: NOT list_contains(list_transform(names, lambda y: lower(y)), x))) END AS extra
FROM (SELECT db_id, list_transform({_TABLES}, lambda x: lower(x)) AS p FROM schemas) FULL JOIN catalogue USING (db_id)"""
oracle(
    "d8_cross_reference", SC, "listed_tables", "catalogue",
    body=f"SELECT db_id, status, array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra FROM ({_COMPARED})",
)
oracle(
    "d8_cross_reference_summary", SC, "listed_tables", "catalogue",
    body=f"""SELECT count_if(status <> 'index only') AS total_in_catalogue, count_if(status <> 'catalogue only') AS total_in_index,
  count_if(status = 'matched') AS matched, count_if(status = 'catalogue only') AS in_catalogue_only, count_if(status = 'index only') AS in_index_only,
  count_if(len(missing) > 0 OR len(extra) > 0) AS table_mismatches,
  round(count_if(status = 'matched') / count_if(status <> 'index only') * 100, 1) AS match_rate FROM ({_COMPARED})""",
)

# ---- examples
oracle("e1_clean_query", *CLEANED, body="SELECT id, sql FROM cleaned")
oracle(
    "e2_attach_schema", EX, SC,
    body="SELECT id, db_id, length(ddl) AS ddl_chars, ddl IS NULL AS is_missing FROM examples LEFT JOIN schemas USING (db_id)",
)
oracle(
    "e3_chat_example", *USABLE, "chat",
    body="SELECT id, system, md5(user_text) AS user_md5, length(user_text) AS user_chars, sql AS assistant FROM chat",
)
_EX_STATUS = f"CASE WHEN {is_blank('query')} THEN 'skipped_empty_query' WHEN ddl IS NULL THEN 'skipped_missing_schema' ELSE 'written' END"
oracle("e4_conversion_status", EX, SC, body=f"SELECT id, {_EX_STATUS} AS status FROM examples LEFT JOIN schemas USING (db_id)")
oracle(
    "e5_conversion_counts", EX, SC,
    body=f"""SELECT source, count(*) AS total, count_if(status = 'written') AS written, count_if(status = 'skipped_empty_query') AS skipped_empty_query,
  count_if(status = 'skipped_missing_schema') AS skipped_missing_schema
FROM (SELECT source, {_EX_STATUS} AS status FROM examples LEFT JOIN schemas USING (db_id)) GROUP BY source""",
)
_CONSTRUCTS = {
    "with_join": _JOIN, "with_group_by": _GROUP, "with_subquery": _FLAGS["has_subquery"], "with_order_by": _FLAGS["has_order_by"],
    "with_limit": _FLAGS["has_limit"], "with_having": _FLAGS["has_having"], "with_distinct": _FLAGS["has_distinct"],
    "with_aggregation": _AGG,
}
oracle(
    "e6_construct_report", *CLEANED, "uppered",
    body="SELECT *, "
    + ", ".join(
        f"round({c} / total_examples * 100, 1) AS pct_{c}"
        for c in ("simple_select", "with_join", "with_group_by", "with_subquery", "with_order_by", "with_aggregation")
    )
    + f" FROM (SELECT count(*) AS total_examples, count_if(NOT {_JOIN}) AS simple_select, "
    + ", ".join(f"count_if({c}) AS {n}" for n, c in _CONSTRUCTS.items())
    + " FROM uppered WHERE source = 'train')",
)


def _rules(n: str, role, content, user_text: str) -> str:
    """Violations of a chat with ``n`` messages, as a list of rule names."""
    out = [f"CASE WHEN {n} IS NOT NULL AND {n} <> 3 THEN 'expected 3 messages' END"]
    for i, r in enumerate(fv.ROLES):
        out.append(f"CASE WHEN {n} = 3 AND {role(i)} IS DISTINCT FROM {q(r)} THEN 'message {i} is not {r}' END")
        out.append(f"CASE WHEN {n} = 3 AND {content(i)} IS NULL THEN 'message {i} has no content' END")
    out.append(f"CASE WHEN {n} = 3 AND NOT contains(coalesce({user_text}, ''), 'Schema:') THEN 'user message has no schema' END")
    out.append(f"CASE WHEN {n} = 3 AND NOT contains(coalesce({user_text}, ''), 'CREATE TABLE') THEN 'user message has no CREATE TABLE' END")
    return "[" + ", ".join(out) + "]"


_CHAT_BROKEN = f"""SELECT * FROM (SELECT id, unnest(list_concat(
    [CASE WHEN NOT json_valid(line) THEN 'invalid JSON' END, CASE WHEN json_valid(line) AND n IS NULL THEN 'missing messages' END],
    {_rules('n', lambda i: f"json_extract_string(j, '$.messages[{i}].role')", lambda i: f"json_extract_string(j, '$.messages[{i}].content')", "json_extract_string(j, '$.messages[1].content')")})) AS violation
  FROM (SELECT *, CASE WHEN json_exists(j, '$.messages') THEN json_array_length(j, '$.messages') END AS n
        FROM (SELECT id, line, CASE WHEN json_valid(line) THEN cast(line AS json) END AS j FROM chat_lines)))
WHERE violation IS NOT NULL"""
oracle("e7_chat_structure", "chat_lines", body=_CHAT_BROKEN)
oracle(
    "e7_conversation_structure",
    body=f"""SELECT * FROM (SELECT conv_id, unnest({_rules('n', lambda i: f'r{i}', lambda i: f't{i}', 't1')}) AS violation FROM (
  SELECT conv_id, count(*) AS n, """
    + ", ".join(f"max(role) FILTER (WHERE turn = {i}) AS r{i}, max(text) FILTER (WHERE turn = {i}) AS t{i}" for i in range(3))
    + " FROM conversations GROUP BY conv_id)) WHERE violation IS NOT NULL",
)

# ---- rewrite
oracle(
    "r1_r7_rewrite_query", *CLEANED, "rewritten_all",
    body="SELECT id, pg_sql, contains(pg_sql, '||') AS has_concatenation FROM rewritten_all",
)
oracle("r8_r13_rewrite_ddl", SC, "pg_schemas", body="SELECT db_id, pg_ddl FROM pg_schemas")
_NO_INSERT = _KEPT.replace("string_split(ddl, chr(10))", f"list_filter(string_split(ddl, chr(10)), lambda l: NOT regexp_matches(l, {q(r'^\s*INSERT\s+INTO\s+')}, 'i'))")
oracle("r8_drop_inserts", SC, body=f"SELECT db_id, {pg_ddl(_NO_INSERT)} AS pg_ddl FROM schemas")
_PG = (*USABLE, "rewritten", "pg_schemas")
_PG_USER = user("p.pg_ddl").replace("db_id", "r.db_id")
oracle(
    "r14_rewrite_examples", *_PG,
    body=f"SELECT id, md5({_PG_USER}) AS user_md5, pg_sql AS assistant FROM rewritten r JOIN pg_schemas p ON r.db_id = p.db_id",
)
oracle(
    "r14_rewrite_chat", *_PG,
    body=f"""SELECT id, md5({_PG_USER}) AS user_md5, pg_sql AS assistant, p.pg_ddl <> p.ddl OR pg_sql <> sql AS changed
FROM rewritten r JOIN pg_schemas p ON r.db_id = p.db_id""",
)
oracle(
    "r15_rewrite_counts", *USABLE, "rewritten",
    body="SELECT source, count(*) AS n, count_if(sql <> pg_sql) AS n_sql_changed FROM rewritten GROUP BY source",
)
oracle(
    "r16_rewrite_accounting", *_PG,
    body=f"""SELECT count(*) AS total_examples, count_if(changed) AS examples_with_conversions, count_if(changed_text) AS changed_beyond_whitespace,
  {", ".join(f"cast(sum({name}) AS bigint) AS {name}" for name in (*_LINE_HITS, *_QUERY_HITS))}
FROM (SELECT p.pg_ddl <> p.ddl OR pg_sql <> sql AS changed,
    {collapsed('p.pg_ddl')} <> {collapsed('p.ddl')} OR {collapsed('pg_sql')} <> {collapsed('sql')} AS changed_text,
    {", ".join(f"{expr.replace('ddl', 'p.ddl')} AS {name}" for name, expr in _LINE_HITS.items())},
    {", ".join(f"{expr} AS {name}" for name, expr in _QUERY_HITS.items())}
  FROM rewritten r JOIN pg_schemas p ON r.db_id = p.db_id)""",
)


def _detected(col: str) -> str:
    return f"contains({col}, '||') AS concatenation, " + ", ".join(f"{has(col, p)} AS {n}" for n, p in fv.DETECTED.items())


oracle("r17_detect_patterns", *CLEANED, body=f"SELECT id, {_detected('sql')} FROM cleaned")
oracle("r17_detect_patterns_ddl", SC, body=f"SELECT db_id, {_detected('ddl')} FROM schemas")


def _issues(col: str, lines: bool = False) -> str:
    items = []
    for pattern, message in fv.RESIDUE:
        test = has(col, pattern)
        if lines and pattern.startswith("^"):
            test = f"len(list_filter(string_split({col}, chr(10)), lambda l: {has('l', pattern)})) > 0"
        items.append(f"CASE WHEN {test} THEN {q(message)} END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


oracle(
    "r18_residue", *CLEANED,
    body=f"SELECT id, array_to_string({_issues('sql')}, '|') AS issues, len({_issues('sql')}) = 0 AS is_clean FROM cleaned",
)
oracle(
    "r19_residue_before", *USABLE,
    body=f"""SELECT scope, issue, count(*) AS n FROM (
  SELECT 'query' AS scope, unnest({_issues('sql')}) AS issue FROM usable
  UNION ALL SELECT 'schema', unnest({_issues('ddl', True)}) FROM usable) GROUP BY scope, issue""",
)
oracle(
    "r19_residue_after", *_PG,
    body=f"""SELECT count(*) AS n_issues, count(DISTINCT concat(scope, issue)) AS n_kinds FROM (
  SELECT 'query' AS scope, unnest({_issues('pg_sql')}) AS issue FROM rewritten
  UNION ALL SELECT 'schema', unnest({_issues('pg_ddl', True)}) FROM rewritten r JOIN pg_schemas p ON r.db_id = p.db_id)""",
)
oracle(
    "r20_changed_pairs", *USABLE, "rewritten",
    body='SELECT id, db_id, sql AS before, pg_sql AS after FROM rewritten WHERE sql <> pg_sql ORDER BY id LIMIT 5',
)

# ---- features and classes
_COUNTS = {
    "join_count": _JOINS,
    "subquery_count": f"greatest(0, {_SELECTS} - 1)",
    "table_count": f"len(regexp_extract_all(u, '\\bFROM\\b')) + {_JOINS}",
}
oracle(
    "f1_f7_features", *CLEANED, "uppered",
    body="SELECT id, " + ", ".join(f"{e} AS {n}" for n, e in {**_FLAGS, **_COUNTS}.items()) + " FROM uppered",
)
oracle("f8_f9_split_class", *LABELLED, body="SELECT id, cast(level AS bigint) AS level, label FROM labelled")
oracle("f10_report_class", *CLEANED, "uppered", body=f"SELECT id, {_REPORT_LABEL} AS label FROM uppered")

# ---- splits
oracle(
    "p1_stratified_split", *LABELLED,
    body=f"""SELECT id, label, CASE WHEN {_SPLIT_RULE} THEN 'validation' ELSE 'test' END AS split FROM (SELECT id, label,
  row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', cast(id AS string))), id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM labelled)""",
)
oracle(
    "p1_stratified_labels",
    body="""SELECT doc_id, cast(quality AS bigint) AS quality, CASE WHEN rn <= floor(n * 0.75) THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, quality,
  row_number() OVER (PARTITION BY quality ORDER BY md5(concat('42|', cast(doc_id AS string))), doc_id) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM labels)""",
)
oracle(
    "p2_split_statistics", *SPLIT,
    body="SELECT split, count(*) AS n_rows, count(DISTINCT db_id) AS n_databases FROM split GROUP BY split",
)
oracle("p2_class_counts", *SPLIT, body="SELECT split, label, count(*) AS n FROM split GROUP BY split, label")
oracle(
    "p3_manifest", *SPLIT,
    body="""SELECT split, 'n_rows' AS metric, count(*) AS value FROM split GROUP BY split
UNION ALL SELECT split, 'n_databases', count(DISTINCT db_id) FROM split GROUP BY split
UNION ALL SELECT split, concat('class:', label), count(*) FROM split GROUP BY split, label
UNION ALL SELECT DISTINCT split, 'seed', cast(42 AS bigint) FROM split""",
)
oracle(
    "p4_overlaps", *SPLIT, "ids", "overlap",
    body="SELECT tv AS train_val_overlap, tt AS train_test_overlap, vt AS val_test_overlap FROM overlap",
)
_DOCS = {"train": "documents WHERE doc_id % 2 = 0", "validation": "documents WHERE doc_id % 2 <> 0", "test": "benchmark"}
oracle(
    "p4_document_overlaps",
    body="SELECT "
    + ", ".join(
        f"(SELECT count(*) FROM (SELECT text FROM {_DOCS[a]} INTERSECT SELECT text FROM {_DOCS[b]})) AS {n}"
        for n, a, b in (
            ("train_val_overlap", "train", "validation"), ("train_test_overlap", "train", "test"),
            ("val_test_overlap", "validation", "test"),
        )
    ),
)
_SHARED = "SELECT question, sql FROM split WHERE split = '{}' AND (question IS NOT NULL OR sql IS NOT NULL)"
oracle(
    "p4_incremental_overlaps", *SPLIT,
    body="\nUNION ALL ".join(
        f"SELECT '{a}' AS first, '{b}' AS second, (SELECT count(*) FROM ({_SHARED.format(a)} INTERSECT {_SHARED.format(b)})) AS shared, true AS within_bound"
        for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))
    ),
)
oracle("t6_incremental_databases", *SPLIT, body="SELECT split, count(DISTINCT db_id) AS n_databases FROM split GROUP BY split")
oracle("p5_drift", *SPLIT, "shares", "drift", body="SELECT round(max_diff, 6) AS max_diff FROM drift")
_GATE = """SELECT 'val_test_overlap' AS check_name, vt = 0 AS passed, concat(vt, ' shared') AS message FROM overlap
UNION ALL SELECT 'train_val_overlap', true, concat(tv, ' shared (warning)') FROM overlap
UNION ALL SELECT 'train_test_overlap', true, concat(tt, ' shared (warning)') FROM overlap
UNION ALL SELECT 'distribution', max_diff <= 5, concat(round(max_diff, 1), ' points') FROM drift"""
oracle("p6_split_gate", *SPLIT, "ids", "overlap", "shares", "drift", body=_GATE)

# ---- statistics
oracle(
    "t1_sections", *USABLE,
    body="SELECT id, md5(ddl) AS schema_md5, question, db_id FROM usable",
)
oracle("t2_document_lengths", body=f"SELECT doc_id, length(text) AS n_chars, {n_tokens('text')} AS n_tokens FROM documents")


def _summary(source: str, group: str, metric: str, value: str) -> str:
    return f"""SELECT {group}, '{metric}' AS metric, count(*) AS n, min(v) AS min, max(v) AS max,
  round(avg(v), 1) AS avg, list_sort(list(v))[count(*) // 2 + 1] AS median FROM (SELECT {group}, {value} AS v FROM {source}) GROUP BY {group}"""


oracle(
    "t3_document_distribution",
    body=_summary("documents", "lang", "text_chars", "length(text)")
    + "\nUNION ALL "
    + _summary("documents", "lang", "text_tokens", n_tokens("text")),
)
_TEXTS = {"schema": "ddl", "question": "question", "sql": "sql"}
_TEXT_SUMMARY = "\nUNION ALL ".join(
    _summary("(SELECT *, source AS split FROM usable)", "split", f"{name}_{unit}", measure(col))
    for name, col in _TEXTS.items()
    for unit, measure in (("chars", "length({})".format), ("tokens", n_tokens))
)
_EMPTY = "\nUNION ALL ".join(f"SELECT 'held back', '{name}_{unit}', 0, 0, 0, 0.0, 0" for name in _TEXTS for unit in ("chars", "tokens"))
oracle("t3_text_distribution", *USABLE, body=f"{_TEXT_SUMMARY}\nUNION ALL {_EMPTY}")
_FEATURES = "\nUNION ALL ".join(
    f"SELECT split, '{n}' AS feature, count_if({e}) AS n, round(count_if({e}) / count(*) * 100, 1) AS pct FROM {{source}} GROUP BY split HAVING count_if({e}) > 0"
    for n, e in _FLAGS.items()
)
_CLASSES = (
    f"SELECT split, label, n, round(n / sum(n) OVER (PARTITION BY split) * 100, 1) AS pct FROM "
    f"(SELECT split, {_REPORT_LABEL} AS label, count(*) AS n FROM {{source}} GROUP BY 1, 2)"
)
oracle("t4_feature_counts", *SPLIT, body=_FEATURES.format(source="split"))
oracle("t5_report_classes", *SPLIT, body=_CLASSES.format(source="split"))
oracle("t6_distinct_databases", *SPLIT, body="SELECT split, count(DISTINCT db_id) AS n_databases FROM split GROUP BY split")
oracle("t7_totals", *SPLIT, body="SELECT split, count(*) AS n FROM split GROUP BY GROUPING SETS ((split), ())")


def _unpivot(body: str, section: str, name: str, stats: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT split, '{section}' AS section, {name} AS name, '{s}' AS stat, cast({s} AS double) AS value FROM ({body})"
        for s in stats
    )


_SRC = f"(SELECT *, source AS split, upper(sql) AS u FROM usable)"
oracle(
    "t7_full_report", *USABLE,
    body="\nUNION ALL ".join(
        [
            _unpivot(f"SELECT split, count(*) AS n FROM {_SRC} GROUP BY GROUPING SETS ((split), ())", "totals", "'examples'", ["n"]),
            _unpivot(f"SELECT split, count(DISTINCT db_id) AS n_databases FROM {_SRC} GROUP BY split", "totals", "'databases'", ["n_databases"]),
            _unpivot(_FEATURES.format(source=_SRC), "sql_features", "feature", ["n", "pct"]),
            _unpivot(_CLASSES.format(source=_SRC), "complexity", "label", ["n", "pct"]),
            _unpivot(_TEXT_SUMMARY, "token_stats", "metric", ["min", "max", "avg", "median"]),
        ]
    ),
)

# ---- model input
RENDERED = ("conv", "prompts", "rendered")
_EXTRA["words"] = "words AS (SELECT conv_id, regexp_extract_all(text, '[^\\s]+') AS w, len(regexp_extract_all(text, '[^\\s]+')) AS n FROM rendered)"
_EXTRA["placed"] = "placed AS (SELECT conv_id, unnest(w) AS token, unnest(range(1, n + 1)) AS p FROM words)"
_EXTRA["numbered"] = "numbered AS (SELECT token, row_number() OVER (ORDER BY c DESC, token) AS token_id FROM (SELECT token, count(*) AS c FROM placed GROUP BY token))"
oracle("i1_render_conversations", *RENDERED, body="SELECT conv_id, text FROM rendered")
_CHAT_TEXT = "concat('<s>[INST] ', system, chr(10), user_text, ' [/INST] ', sql, '</s>')"
oracle("i1_render_messages", *USABLE, "chat", body=f"SELECT id, md5({_CHAT_TEXT}) AS text_md5 FROM chat")
oracle("i2_prompts", "conv", "prompts", body="SELECT conv_id, prompt FROM prompts")
_DEMO = f"""CASE WHEN ddl IS NULL OR {is_blank('ddl')} THEN {q(fv.DEMO_NO_SCHEMA)} WHEN {is_blank('query')} THEN {q(fv.DEMO_NO_QUESTION)}
  ELSE concat({nl(fv.DEMO_PROMPT[0])}, {stripped('ddl')}, {nl(fv.DEMO_PROMPT[1])}, {stripped('query')}, {nl(fv.DEMO_PROMPT[2])}) END"""
oracle(
    "i2_demo_prompts", EX, SC,
    body=f"SELECT id, md5(p) AS prompt_md5, starts_with(p, 'Error: ') AS is_error FROM (SELECT id, {_DEMO} AS p FROM examples LEFT JOIN schemas USING (db_id))",
)
oracle(
    "i3_sequence_budget", *RENDERED,
    body=f"""SELECT conv_id, n AS n_tokens, least(n, 200) AS kept_tokens, greatest(200 - n, 0) AS pad_tokens, n > 200 AS truncated, p >= 200 AS answer_lost
FROM (SELECT conv_id, {n_tokens('text')} AS n, {n_tokens('prompt')} AS p FROM rendered)""",
)
oracle(
    "i3_budget_summary", *USABLE, "chat",
    body=f"""SELECT count(*) AS n_rows, count_if(n > 60) AS n_truncated, count_if(p >= 60) AS n_answer_lost, max(n) AS max_tokens,
  round(count_if(n > 60) / count(*) * 100, 1) AS pct_truncated
FROM (SELECT {n_tokens(_CHAT_TEXT)} AS n, {n_tokens("concat('<s>[INST] ', system, chr(10), user_text, ' [/INST]')")} AS p FROM chat)""",
)
oracle(
    "i3_model_tensors", *RENDERED, "words", "placed", "numbered",
    body="""SELECT conv_id, s AS input_ids, rtrim(concat(repeat('1 ', least(n, 64)), repeat('0 ', greatest(64 - n, 0)))) AS attention_mask, s AS labels FROM (
  SELECT w.conv_id, n, array_to_string(list_concat(coalesce(ids, []), list_transform(range(least(n, 64), 64), lambda x: 0)), ' ') AS s
  FROM words w LEFT JOIN (
    SELECT conv_id, list(token_id ORDER BY p) AS ids FROM placed JOIN numbered USING (token) WHERE p <= 64 GROUP BY conv_id) k USING (conv_id))""",
)
oracle(
    "i4_load_training_data", *USABLE, "chat",
    body=f"""SELECT CASE WHEN source = 'dev' THEN 'validation' ELSE 'train' END AS side, count(*) AS n, cast(sum(length(t)) AS bigint) AS chars, max(md5(t)) AS last_md5
FROM (SELECT source, {_CHAT_TEXT} AS t FROM chat) GROUP BY 1""",
)
_PG_TEXT = f"concat('<s>[INST] ', {q(fv.SYSTEM_PROMPT)}, chr(10), {_PG_USER}, ' [/INST] ', pg_sql, '</s>')"
oracle(
    "i4_training_text", *_PG,
    body=f"""SELECT source, count(*) AS n, cast(sum(t) AS bigint) AS n_tokens, count_if(t > 60) AS n_truncated
FROM (SELECT source, {n_tokens(_PG_TEXT)} AS t FROM rewritten r JOIN pg_schemas p ON r.db_id = p.db_id) GROUP BY source""",
)

# ---- scoring
oracle(
    "x1_seeded_sample", EX,
    body="SELECT id, query FROM examples ORDER BY md5(concat('42|', cast(id AS string))), id LIMIT 50",
)
oracle(
    "x2_completions", "predictions",
    body=f"SELECT id, {completion('generated')} AS completion, {demo_completion('generated')} AS demo_completion FROM predictions",
)
oracle("x3_normalise", EX, body=f"SELECT id, {normalised('query')} AS normalised FROM examples")
SCORED = (*LABELLED, "predictions", "scored")
oracle("x4_exact_match", *SCORED, body="SELECT id, exact_match FROM scored")
oracle(
    "x5_accuracy", *SCORED,
    body="SELECT count(*) AS num_samples, count_if(exact_match) AS exact_matches, count_if(exact_match) / count(*) AS exact_match_accuracy FROM scored",
)
oracle(
    "x5_accuracy_per_class", *SCORED,
    body="""SELECT label, count(*) AS num_samples, count_if(exact_match) AS exact_matches,
  round(count_if(exact_match) / count(*), 6) AS exact_match_accuracy FROM scored GROUP BY label""",
)
oracle(
    "x5_report_records", *SCORED,
    body="""SELECT id, CASE WHEN length(prompt) > 200 THEN concat(prompt[1:200], '...') ELSE prompt END AS prompt, reference, generated, exact_match
FROM scored ORDER BY id LIMIT 10""",
)
oracle("x6_perplexity", "trainlog", body="SELECT run_id, round(exp(avg(loss)), 6) AS perplexity FROM trainlog GROUP BY run_id")

# ---- training log, roll-up, catalogue
oracle(
    "l1_progress", "trainlog",
    body="""SELECT run_id, step, round(CASE WHEN total > 0 THEN step / total ELSE 0 END * 100, 1) AS progress_pct, round(elapsed, 3) AS elapsed_s,
  round(CASE WHEN total > 0 AND step / total > 0 THEN elapsed / (step / total) - elapsed END, 3) AS remaining_s
FROM (SELECT run_id, step, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY run_id))) / 1000000 AS elapsed,
  max(step) OVER (PARTITION BY run_id) AS total FROM trainlog)""",
)


def _plateau(patience: int, delta: str, result: str = "SELECT * FROM verdicts") -> str:
    delta = f"cast({delta} AS double)"
    return f""", evals AS (SELECT run_id, step, loss, row_number() OVER (PARTITION BY run_id ORDER BY step) AS k,
  count(*) OVER (PARTITION BY run_id) AS total FROM trainlog WHERE loss IS NOT NULL),
walk AS (SELECT run_id, k, total, loss AS best, 0 AS wait, cast(NULL AS bigint) AS stop_step FROM evals WHERE k = 1
  UNION ALL SELECT e.run_id, e.k, e.total, CASE WHEN e.loss < w.best - {delta} THEN e.loss ELSE w.best END,
    CASE WHEN e.loss < w.best - {delta} THEN 0 ELSE w.wait + 1 END,
    CASE WHEN NOT e.loss < w.best - {delta} AND w.wait + 1 >= {patience} THEN e.step END
  FROM walk w JOIN evals e ON e.run_id = w.run_id AND e.k = w.k + 1 WHERE w.stop_step IS NULL),
verdicts AS (SELECT run_id, max(total) AS evaluations, arg_max(stop_step, k) FILTER (WHERE stop_step IS NOT NULL) AS stop_step,
  round(arg_max(best, k), 9) AS best_loss, cast(arg_max(wait, k) AS bigint) AS wait_count FROM walk GROUP BY run_id)
{result}"""


oracle("l2_plateau", "trainlog", body=_plateau(3, "0.01"))
oracle(
    "l2_plateau_stream", "trainlog",
    body=_plateau(3, "0.01", "SELECT run_id, stop_step, best_loss, wait_count FROM verdicts WHERE stop_step IS NOT NULL"),
)
oracle("l2_plateau_patient", "trainlog", body=_plateau(60, "0.5"))
_CLEAN_LEFT = f"(SELECT count(*) AS n FROM rewritten_all WHERE len({_issues('pg_sql')}) > 0)"
_CHECKS = f"""SELECT 'required_fields' AS check_name, valid = total AS passed, CASE WHEN valid = total THEN 'all valid' WHEN valid > 0 THEN 'some valid' ELSE 'none valid' END AS message
  FROM (SELECT count(*) AS total, count_if(len({_MISSING}) = 0) AS valid FROM raw_lines)
UNION ALL SELECT 'chat_structure', n = 0, cast(n AS string) FROM (SELECT count(*) AS n FROM chat_broken)
UNION ALL SELECT 'residue', n = 0, cast(n AS string) FROM {_CLEAN_LEFT}
UNION ALL {_GATE}"""
_EXTRA["chat_broken"] = f"chat_broken AS ({_CHAT_BROKEN})"
_EXTRA["checks"] = f"checks AS ({_CHECKS})"
oracle(
    "l3_check_roll_up", *SPLIT, "ids", "overlap", "shares", "drift", "raw_lines", "chat_lines", "chat_broken", "rewritten_all", "checks",
    body="""SELECT *, false AS is_total FROM checks
UNION ALL SELECT 'all_passed', bool_and(passed), concat(count_if(NOT passed), ' failed'), true FROM checks""",
)
oracle(
    "g1_catalogue_questions", "demo_catalogue",
    body="""SELECT name, cast(0 AS bigint) AS pos, q1 AS question FROM demo_catalogue UNION ALL SELECT name, cast(1 AS bigint), q2 FROM demo_catalogue""",
)


def _findings(col: str) -> str:
    items = [f"CASE WHEN contains({col}, {q(w)}) THEN {q(m)} END" for w, m in fv.CATALOGUE_FORBIDDEN]
    items += [f"CASE WHEN NOT contains({col}, {q(w)}) THEN {q(m)} END" for w, m in fv.CATALOGUE_REQUIRED]
    return "[" + ", ".join(items) + "]"


oracle(
    "g2_catalogue_check", SC, "pg_schemas",
    body=f"""SELECT * FROM (SELECT db_id, unnest({_findings('ddl')}) AS finding, 'before' AS stage FROM pg_schemas
UNION ALL SELECT db_id, unnest({_findings('pg_ddl')}), 'after' FROM pg_schemas) WHERE finding IS NOT NULL""",
)
