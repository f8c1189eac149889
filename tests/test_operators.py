"""Examples, rewrite, skewed joins, checks, model input, scoring."""

import json

import pytest
from pyspark.sql import functions as F

from sqlcorpus import fixed_values as fv
from sqlcorpus.functions import sqltext as st
from sqlcorpus.operators import checks, examples as ex, model_input, rewrite, scoring
from sqlcorpus.operators.skew import hot_keys, join_wide, measured_bytes, salted_left_join
from sqlcorpus.registry.derived import schemas as schemas_of
from sqlcorpus.registry.derived import view

EXAMPLE = "id long, db_id string, question string, query string, source string"


@pytest.fixture
def tiny(spark):
    rows = [
        (1, "shop", "q1", "SELECT  1", "train"),
        (2, "shop", "q2", "  ", "train"),
        (3, "gone", "q3", "SELECT 3;", "dev"),
        (4, "gone", "q4", "", "dev"),
        (5, None, "q5", "SELECT 5", "dev"),
        (6, "shop", "q6", "SELECT x FROM t WHERE d < DATE('now')", "dev"),
    ]
    schemas = [("shop", "PRAGMA x;\nCREATE TABLE t (id INTEGER PRIMARY KEY AUTOINCREMENT);"), ("null", None)]
    return spark.createDataFrame(rows, EXAMPLE), spark.createDataFrame(schemas, "db_id string, ddl string")


def test_status_and_counts(tiny):
    examples, schemas = tiny
    status = {r.id: r.status for r in ex.with_status(examples, schemas).collect()}
    assert status == {
        1: "written", 2: "skipped_empty_query", 3: "skipped_missing_schema", 4: "skipped_empty_query",
        5: "skipped_missing_schema", 6: "written",
    }
    counts = {r.source: tuple(r)[1:] for r in ex.conversion_counts(examples, schemas).collect()}
    assert counts == {"train": (2, 1, 1, 0), "dev": (4, 1, 1, 2)}
    assert {r.id for r in ex.usable(examples, schemas).collect()} == {1, 6}


def test_chat_rows(tiny):
    rows = ex.chat_rows(ex.convert(*tiny), "id").orderBy("id").collect()
    assert [m.role for m in rows[0].messages] == fv.ROLES
    assert rows[0].messages[0].content == fv.SYSTEM_PROMPT
    assert rows[0].messages[1].content.startswith("Database: shop\n\nSchema:\nPRAGMA x;\nCREATE TABLE t")
    assert rows[0].messages[1].content.endswith("\n\nQuestion: q1\n\nGenerate the SQL query:")
    assert rows[0].messages[2].content == "SELECT 1;"


def test_sources(spark, tiny):
    examples, _ = tiny
    raw = examples.drop("source")
    sources = {"train": raw.where("id < 3"), "dev": None}
    assert {r.source for r in ex.union_sources(sources).collect()} == {"train"}
    assert [tuple(r) for r in ex.source_errors(spark, sources).collect()] == [("dev", "File not found: dev")]


def test_rewritten_forms_agree(tiny):
    examples, schemas = tiny
    native = {r.id: (r.user, r.assistant) for r in rewrite.rewrite_examples(ex.usable(examples, schemas), schemas).collect()}
    chat = ex.convert(examples, schemas).select("id", *fv.ROLES)
    once = {r.id: (r.new_user, r.new_assistant) for r in rewrite.rewrite_chat_once(chat, "id").collect()}
    plain = {r.id: (r.new_user, r.new_assistant) for r in rewrite.rewrite_chat(chat).collect()}
    assert native == once == plain and set(native) == {1, 6}
    user, answer = native[6]
    assert "PRAGMA" not in user and "SERIAL PRIMARY KEY" in user and answer == "SELECT x FROM t WHERE d < CURRENT_DATE;"


def test_chat_without_sections_is_kept(spark):
    chat = spark.createDataFrame([(1, "s", "no marks PRAGMA x", "SELECT 1")], "id long, system string, user string, assistant string")
    for form in (rewrite.rewrite_chat(chat), rewrite.rewrite_chat_once(chat, "id")):
        row = form.first()
        assert row.new_user == row.user and not row.changed


def test_accounting_counts_per_example(tiny):
    examples, schemas = tiny
    row = rewrite.rewrite_accounting(ex.usable(examples, schemas), schemas).first()
    assert (row.total_examples, row.examples_with_conversions) == (2, 2)
    assert (row.pragma_removals, row.autoincrement_to_serial, row.date_now) == (2, 2, 1)


def test_residue_sample(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "DATE('now')"), (3, "DATE('now')")], "id long, sql string")
    assert [tuple(r) for r in rewrite.residue_sample(rows, "id", "sql", 2).collect()] == [(2, "DATE('now') not converted")]


def test_changed_pairs(spark):
    rows = spark.createDataFrame([(1, "d", "a", "a"), (2, "d", "a", "b"), (3, "d", "x", "y")], "id long, db_id string, sql string, pg_sql string")
    assert [tuple(r) for r in rewrite.changed_pairs(rows, "id").collect()] == [(2, "d", "a", "b")]
    assert rewrite.changed_pairs(rows.where("id = 1"), "id").count() == 0


# ---- skew --------------------------------------------------------------------------------------


def test_salted_join_equals_plain_join(spark, sf):
    examples, schemas = view(spark, sf, "examples"), schemas_of(spark, sf)
    plain = examples.join(schemas, "db_id", "left").select("id", "db_id", "ddl")
    salted = salted_left_join(examples, schemas, "db_id", "id", rows_per_salt=40).select("id", "db_id", "ddl")
    assert plain.exceptAll(salted).count() == 0 and salted.exceptAll(plain).count() == 0
    hot = {r.db_id: r._salts for r in hot_keys(examples, "db_id", 40).collect()}
    n = examples.where("db_id = 'db_1'").count()
    assert hot["db_1"] == -(-n // 40) and len(hot) <= examples.count() / 40


def test_salting_spreads_the_hot_key(spark, sf):
    """In a shuffle join; a small wide side would be broadcast and nothing shuffled."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    examples, schemas = view(spark, sf, "examples"), schemas_of(spark, sf)
    tasks = lambda joined: joined.where("db_id = 'db_1'").groupBy(F.spark_partition_id()).count().count()
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        salted = tasks(salted_left_join(examples, schemas, "db_id", "id", rows_per_salt=20))
        plain = tasks(examples.join(schemas, "db_id", "left"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plain == 1 and salted > 1


def test_salted_join_keeps_rows_without_key(spark):
    large = spark.range(90).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'hot' ELSE 'none' END AS k")
    wide = spark.createDataFrame([("hot", "text"), (None, "never")], "k string, t string")
    out = salted_left_join(large, wide, "k", "id", rows_per_salt=4).collect()
    assert len(out) == 90 and len({r.id for r in out}) == 90
    assert all(r.t == ("text" if r.k == "hot" else None) for r in out)


def test_join_strategy_follows_measured_size(spark, sf):
    examples, schemas = view(spark, sf, "examples"), schemas_of(spark, sf)
    size = measured_bytes(schemas, ["ddl"])
    assert size > schemas.agg(F.sum(F.length("ddl"))).first()[0]

    def plan(limit):
        df = join_wide(examples, schemas, "db_id", "id", ["ddl"], broadcast_bytes=limit)
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert "_salt" not in plan(size) and "_salt" in plan(size - 1)


# ---- checks ------------------------------------------------------------------------------------


def test_required_fields(spark):
    lines = ['{"question": "q", "query": "s", "db_id": null}', '{"question": "q"}', "not json", "{}"]
    raw = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    checked = checks.with_missing_fields(raw, "line")
    assert [r.missing for r in checked.orderBy("id").collect()][:2] == [[], ["query", "db_id"]]
    row = checks.field_check(checked).first()
    assert (row.total, row.valid, row.invalid, row.status) == (4, 1, 3, "some valid")
    assert [r.id for r in checks.first_offenders(checked, "id").collect()] == [1, 2, 3]


def test_chat_structure_rules(spark):
    def chat(*messages):
        return json.dumps({"messages": [dict(zip(("role", "content"), m)) for m in messages]})

    good = chat(("system", "s"), ("user", "Schema: CREATE TABLE"), ("assistant", "x"))
    lines = [
        good, "{", '{"a": 1}', chat(("system", "s")),
        chat(("system", "s"), ("assistant", "u"), ("assistant",)), "",
    ]
    df = spark.createDataFrame(list(enumerate(lines)), "id int, line string")
    found = {}
    for r in ex.chat_line_violations(df, "line", ["id"]).collect():
        found.setdefault(r.id, set()).add(r.violation)
    assert found == {
        1: {"invalid JSON"}, 2: {"missing messages"}, 3: {"expected 3 messages"},
        4: {"message 1 is not user", "message 2 has no content", "user message has no schema", "user message has no CREATE TABLE"},
        5: {"invalid JSON"},
    }


def test_roll_up(spark):
    one = spark.createDataFrame([(0,)], "n long")
    ok = checks.check_row(one, "a", F.col("n") == 0, F.lit("fine"))
    bad = checks.check_row(one, "b", F.col("n") == 1, F.lit(None).cast("string"))
    rows = {r.check_name: (r.passed, r.message) for r in checks.roll_up([ok, bad]).collect()}
    assert rows == {"a": (True, "fine"), "b": (False, ""), "all_passed": (False, "1 failed")}
    assert checks.roll_up([ok]).where("is_total").first().passed


def test_manifest_and_coverage(spark):
    expected = spark.createDataFrame([("a",), ("b",)], "name string")
    observed = spark.createDataFrame([("a", 3 * 1024 * 1024, 7)], "name string, size_bytes long, examples long")
    rows = {tuple(r) for r in checks.manifest_check(expected, observed).collect()}
    assert rows == {("a", True, 3.0, 7), ("b", False, 0.0, 0)}
    files = spark.createDataFrame([("x", "/x/x.sqlite"), ("x", "/x/s.sql"), ("y", "/y/s.sql")], "db_id string, path string")
    row = checks.database_coverage(files, minimum=1).first()
    assert (row.total_dbs, row.dbs_with_sqlite, row.passed) == (2, 1, True)
    assert [r.db_id for r in checks.databases_without_file(files).collect()] == ["y"]


# ---- model input -------------------------------------------------------------------------------


def test_render_messages(spark):
    both = [("system", "S"), ("user", "U1"), ("user", "U2"), ("assistant", "A")]
    none = [("user", "U"), ("assistant", None)]
    df = spark.createDataFrame([(1, both), (2, none)], "id int, messages array<struct<role:string,content:string>>")
    out = {r.id: r.text for r in model_input.render_messages(df, "id").collect()}
    assert out == {1: "<s>[INST] S\nU2 [/INST] A</s>", 2: "<s>[INST] U [/INST] </s>"}


def test_budget_counts_text_tokens(spark, sf):
    chat = ex.convert(view(spark, sf, "examples"), schemas_of(spark, sf))
    rendered = model_input.with_rendering(chat)
    by_text = {r.id: len(r.text.split()) for r in rendered.select("id", "text").collect()}
    full = model_input.sequence_budget(rendered, 60).select("id", "n_tokens", "kept_tokens", "pad_tokens", "truncated", "answer_lost")
    usable = ex.usable(view(spark, sf, "examples"), schemas_of(spark, sf))
    parts = model_input.example_budget(usable, schemas_of(spark, sf), max_length=60).select(*full.columns)
    assert {r.id: r.n_tokens for r in full.collect()} == by_text
    assert full.exceptAll(parts).count() == 0 and full.count() == parts.count()
    assert all(r.kept_tokens + r.pad_tokens == 60 or r.truncated for r in full.collect())


def test_tokenised_has_fixed_length(spark):
    def encoder():
        return lambda texts: [[len(word) for word in text.split()] for text in texts]

    df = spark.createDataFrame([(1, "a bb ccc"), (2, "a b c d e f"), (3, None)], "id int, text string")
    rows = {r.id: r for r in model_input.tokenised(df, encoder, max_length=4, pad_id=9).collect()}
    assert rows[1].input_ids == [1, 2, 3, 9] and rows[1].attention_mask == [1, 1, 1, 0]
    assert rows[2].input_ids == [1, 1, 1, 1] and rows[2].attention_mask == [1, 1, 1, 1]
    assert rows[3].input_ids == [9] * 4 and rows[3].attention_mask == [0] * 4
    assert all(r.labels == r.input_ids for r in rows.values())


def test_truncated_tokens(evaluate):
    assert evaluate(lambda c: model_input.truncated_tokens(c, 2), [" a b  c "]) == [["a", "b"]]


# ---- scoring -----------------------------------------------------------------------------------


def test_scoring(spark):
    refs = spark.createDataFrame(
        [(1, "SELECT a;", "p" * 300), (2, "SELECT b", "p"), (3, "", "p")], "id long, reference string, prompt string"
    )
    preds = spark.createDataFrame([(1, "x [/INST] select  A ;</s>"), (2, "SELECT c")], "id long, generated string")
    scored = scoring.score(refs, preds)
    assert {r.id: r.exact_match for r in scored.collect()} == {1: True, 2: False, 3: True}
    row = scoring.accuracy(scored).first()
    assert (row.num_samples, row.exact_matches) == (3, 2) and abs(row.exact_match_accuracy - 2 / 3) < 1e-12
    assert scoring.accuracy(scored.where("id < 0")).first().exact_match_accuracy == 0
    assert scoring.report_records(scored).first().prompt == "p" * 200 + "..."


def test_sample_is_stable_and_whole_when_small(spark):
    df = spark.range(500).withColumnRenamed("id", "id")
    first = [r.id for r in scoring.seeded_sample(df).collect()]
    again = [r.id for r in scoring.seeded_sample(df.repartition(7)).collect()]
    assert first == again and len(first) == 50
    assert scoring.seeded_sample(df.where("id < 20")).count() == 20


def test_perplexity_overflow(spark):
    df = spark.createDataFrame([(1, 800.0), (2, 0.0), (2, None)], "run_id int, loss double")
    assert {r.run_id: r.perplexity for r in scoring.perplexity(df, "loss", "run_id").collect()} == {1: float("inf"), 2: 1.0}


def test_exact_match_pairs(spark):
    df = spark.createDataFrame([("SELECT COUNT(*) FROM users;", "  select  count(*)   from   users  ;  "), ("SELECT a", "SELECT b")], "g string, r string")
    assert [r[0] for r in df.select(scoring.exact_match(F.col("g"), F.col("r"))).collect()] == [True, False]
    assert df.select(st.normalise_query(F.col("g"))).first()[0] == "select count(*) from users"


def test_evaluation_report(spark):
    refs = spark.range(80).selectExpr("id", "concat('SELECT ', id) AS reference", "'p' AS prompt")
    preds = spark.range(80).selectExpr("id", "CASE WHEN id % 2 = 0 THEN concat('select ', id) END AS generated")
    totals, records = scoring.evaluation(refs, preds)
    sample = [r.id for r in scoring.seeded_sample(refs).collect()]
    row = totals.first()
    assert (row.num_samples, row.exact_matches) == (50, sum(i % 2 == 0 for i in sample))
    assert [int(r.reference.split()[1]) for r in records.collect()] == sample[:10]


def test_load_training_data(spark):
    rows = [(i, [("user", f"u{i}"), ("assistant", "a")]) for i in range(5)]
    df = spark.createDataFrame(rows, "pos int, messages array<struct<role:string,content:string>>")
    train, validation = model_input.load_training_data(df, df, ["pos"], max_samples=2)
    assert [r.text for r in train.orderBy("pos").collect()] == ["<s>[INST] u0 [/INST] a</s>", "<s>[INST] u1 [/INST] a</s>"]
    assert model_input.load_training_data(df, df, ["pos"])[1].count() == 5 and validation.count() == 2


def test_required_files(spark):
    observed = spark.createDataFrame([("dev.json", 1, 1)], "name string, size_bytes long, examples long")
    row = checks.all_present(checks.manifest_check(checks.required_files(spark), observed, 2)).first()
    assert (row.all_present, row.n_missing) == (False, 3)
