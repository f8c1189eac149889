"""Registered Spark queries. Each takes (session, directory of the tables) and covers whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sqlcorpus import fixed_values as fv
from sqlcorpus.functions import ddl as d
from sqlcorpus.functions import dialect as dl
from sqlcorpus.functions import features as ft
from sqlcorpus.functions import sqltext as st
from sqlcorpus.functions.text import token_count
from sqlcorpus.operators import checks, examples as ex, increments, model_input, rewrite, schemas as sch, scoring, splits, stats, trainlog
from sqlcorpus.plans import corpus
from sqlcorpus.registry.derived import schemas, table, view
from sqlcorpus.session import scratch_path, stage
from sqlcorpus.sources import readers, writers
from sqlcorpus.streaming import late_plateau

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def registered(fn: Query) -> Query:
    """Register under the function name, with one integer type in all results."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        widened = {
            f.name: F.col(f.name).cast("long")
            for f in df.schema.fields
            if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))
        }
        return df.withColumns(widened) if widened else df

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def _examples(spark, sf):
    return view(spark, sf, "examples")


def _schemas(spark, sf):
    return schemas(spark, sf)


def _usable(spark, sf):
    return ex.usable(_examples(spark, sf), _schemas(spark, sf))


def _catalogue(spark, sf):
    listed = view(spark, sf, "listed_tables")
    return listed.select("db_id", F.array_distinct(F.array("t1", "t2", "t3")).alias("table_names_original"))


def _cleaned(spark, sf):
    """All examples with a cleaned query; nothing is skipped and nothing is joined."""
    return _examples(spark, sf).withColumn("sql", st.clean_query(F.col("query")))


def _labelled(spark, sf):
    return corpus.classified(_cleaned(spark, sf), "sql")


def _split(spark, sf):
    return corpus.final_splits(_labelled(spark, sf), durable_cuts=True, stage_labels=True)


# ---- sources and sinks -------------------------------------------------------------------------


@registered
def s1_example_arrays(spark, sf):
    """JSON array documents to example rows (documents of at most 100 examples each)."""
    rows = _examples(spark, sf).select(
        F.floor(F.col("id") / 100).alias("doc"), F.struct("db_id", "question", "query").alias("r")
    )
    documents = rows.groupBy("doc").agg(F.to_json(F.collect_list("r")).alias("body"))
    return readers.array_documents(documents, "body", "doc").select("doc", "db_id", "question", "query")


def _array_files(spark, sf):
    """Example array files of 5,000 orders each; every third one is cut off in its middle."""
    rows = _examples(spark, sf).select(F.floor(F.col("id") / 5000).alias("doc"), F.struct("db_id", "question", "query").alias("r"))
    body = rows.groupBy("doc").agg(F.to_json(F.collect_list("r")).alias("body"))
    cut = F.when(F.col("doc") % 3 == 2, F.substring("body", F.lit(1), F.floor(F.length("body") / 2).cast("int"))).otherwise(F.col("body"))
    path = scratch_path(spark, "arrays")
    body.select("doc", cut.alias("body")).write.partitionBy("doc").text(path)
    return path


def _doc_of_file():
    return F.regexp_extract("file", "doc=([0-9]+)", 1).cast("long").alias("doc")


@registered
def s1_example_files(spark, sf):
    """Array files read back, broken ones left out; examples counted and hashed per file."""
    good, _ = readers.read_example_files(spark, _array_files(spark, sf))
    return good.groupBy(_doc_of_file()).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("query")).alias("query_chars"), F.min("question").alias("first_question"))


@registered
def e5_source_errors(spark, sf):
    """Files that are no JSON and a source that does not exist."""
    _, rejects = readers.read_example_files(spark, _array_files(spark, sf))
    errors = ex.source_errors(spark, {"dev": None}, rejects)
    return errors.select(F.regexp_replace("source", "^.*/doc=([0-9]+)/.*$", "$1").alias("source"), "error")


@registered
def s2_jsonl_strict(spark, sf):
    """Write chat JSON lines, read them back with the strict reader."""
    chat = ex.convert(_examples(spark, sf), _schemas(spark, sf))
    path = scratch_path(spark, "jsonl")
    writers.write_jsonl(ex.chat_rows(chat), path)
    back = readers.read_jsonl(spark, path)
    return back.select(
        *[st.last_content(F.col("messages"), role).alias(role) for role in fv.ROLES]
    ).select("system", F.md5("user").alias("user_md5"), "assistant")


@registered
def s3_jsonl_tolerant(spark, sf):
    """Good, blank and broken lines told apart; no line is lost."""
    return readers.classify_lines(view(spark, sf, "json_lines")).select("event_id", "line_status")


@registered
def s3_jsonl_tolerant_files(spark, sf):
    """The same from files: lines of the quarantine and of the good side."""
    path = scratch_path(spark, "lines")
    view(spark, sf, "json_lines").select("line").write.text(path)
    good, broken = readers.read_jsonl_tolerant(spark, path, "k bigint")
    return good.groupBy(F.lit("ok").alias("side")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        broken.groupBy(F.lit("broken").alias("side")).agg(F.count(F.lit(1)).alias("n"))
    )


@registered
def s4_ddl_corpus(spark, sf):
    """One DDL file per database directory, written and read back."""
    path = scratch_path(spark, "ddl")
    writers.write_ddl_corpus(view(spark, sf, "supplier_ddl"), path)
    back = readers.read_ddl_corpus(spark, path, "*.txt")
    return back.select("db_id", F.rtrim(F.col("ddl"), F.lit("\n")).alias("ddl"))


@registered
def s5_catalogue(spark, sf):
    """Catalogue array files of at most 1,000 databases, read back: rows with lower-cased table names."""
    path = scratch_path(spark, "catalogue")
    doc = F.pmod(F.xxhash64("db_id"), F.greatest(F.lit(1), F.lit(_catalogue(spark, sf).count() // 500))).alias("doc")
    arrays = _catalogue(spark, sf).groupBy(doc).agg(F.to_json(F.collect_list(F.struct("db_id", "table_names_original"))).alias("body"))
    arrays.write.partitionBy("doc").text(path)
    back = readers.read_catalogue(spark, path)
    return back.select("db_id", F.explode("table_names_original").alias("t")).select("db_id", F.lower("t").alias("table_name"))


@registered
def s6_write_jsonl(spark, sf):
    """Examples per source as JSON lines; counted per partition folder after reading back."""
    path = scratch_path(spark, "out")
    writers.write_jsonl(_cleaned(spark, sf), path, "source", keep_nulls=True)
    back = spark.read.schema("id bigint, db_id string, question string, query string, sql string, source string").json(path)
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sql")).alias("sql_chars"))


@registered
def s7_write_schema_index(spark, sf):
    """The schema index as Parquet with its DDL, read back."""
    path = scratch_path(spark, "index")
    writers.write_schema_index(_schemas(spark, sf), path)
    return spark.read.parquet(path).select("db_id", "num_tables", "has_pragma", F.md5("ddl").alias("ddl_md5"))


@registered
def s8_write_reports(spark, sf):
    """The construct report as a JSON file, read back."""
    path = scratch_path(spark, "report")
    report = ex.construct_report(_cleaned(spark, sf))
    writers.write_report(report, path)
    return spark.read.schema(report.schema).json(path).select("total_examples", "with_join", "pct_with_join")


# ---- ingest checks -----------------------------------------------------------------------------


@registered
def v1_manifest(spark, sf):
    """Expected against written files: presence, size, lines, and whether all are there."""
    path = scratch_path(spark, "manifest")
    _cleaned(spark, sf).select("source", "question").write.partitionBy("source").text(path)
    files = readers.list_files(spark, path, "*.txt")
    lines = spark.read.text(path, recursiveFileLookup=True).groupBy(F.col("_metadata.file_path").alias("p")).agg(
        F.count(F.lit(1)).alias("examples")
    )
    by_file = files.join(lines, F.url_decode(F.col("p")) == F.url_decode(F.col("path")), "left")
    observed = by_file.groupBy(F.regexp_replace("db_id", "source=", "").alias("name")).agg(
        F.sum("size_bytes").alias("size_bytes"), F.sum("examples").alias("examples")
    )
    expected = spark.createDataFrame([("train",), ("dev",), ("others",)], "name string")
    manifest = checks.manifest_check(expected, observed, 3)
    # one row for the whole manifest
    return manifest.join(F.broadcast(checks.all_present(manifest)))


@registered
def v2_required_fields(spark, sf):
    checked = checks.with_missing_fields(view(spark, sf, "raw_lines"), "line")
    return checks.field_check(checked)


@registered
def v2_first_offenders(spark, sf):
    checked = checks.with_missing_fields(view(spark, sf, "raw_lines"), "line")
    return checks.first_offenders(checked, "id")


@registered
def v3_keyword_frequency(spark, sf):
    return checks.top_keywords(checks.keyword_frequency(_examples(spark, sf)))


@registered
def v3_keyword_frequency_words(spark, sf):
    return checks.keyword_frequency(_examples(spark, sf), mode="word").select("keyword", "n")


@registered
def v4_database_coverage(spark, sf):
    return checks.database_coverage(view(spark, sf, "db_files"))


@registered
def v4_databases_without_file(spark, sf):
    return checks.databases_without_file(view(spark, sf, "db_files"))


# ---- DDL extraction ----------------------------------------------------------------------------


@registered
def d1_table_names(spark, sf):
    return sch.schema_tables(_schemas(spark, sf))


@registered
def d2_column_names(spark, sf):
    return sch.schema_columns(_schemas(spark, sf))


@registered
def d3_foreign_keys(spark, sf):
    return sch.schema_foreign_keys(_schemas(spark, sf)).drop("pos", "kind")


@registered
def d4_ddl_flags(spark, sf):
    ddl = F.col("ddl")
    return _schemas(spark, sf).select(
        "db_id",
        d.has_foreign_keys(ddl).alias("has_foreign_keys"),
        d.has_primary_keys(ddl).alias("has_primary_keys"),
        d.has_pragma(ddl).alias("has_pragma"),
        F.length(ddl).alias("content_length"),
    )


@registered
def d5_ddl_check(spark, sf):
    """Check of whole and of cut texts."""
    ddl = F.col("ddl")
    cut = _schemas(spark, sf).withColumn(
        "ddl", F.when(F.length("db_id") % 3 == 0, F.substring_index(ddl, "(", 3)).otherwise(ddl)
    )
    return cut.select(
        "db_id", d.ddl_is_valid(ddl).alias("is_valid"), F.array_join(d.ddl_warnings(ddl), "|").alias("warnings")
    )


@registered
def d6_schema_index(spark, sf):
    index = sch.schema_index(_schemas(spark, sf))
    return index.select(
        "db_id", "num_tables", F.array_join("tables", ",").alias("tables"),
        F.size("table_columns").alias("n_described"), F.size("foreign_keys").alias("n_foreign_keys"),
        "has_foreign_keys", "has_primary_keys", "has_pragma", "content_length",
    )


@registered
def d7_index_statistics(spark, sf):
    """Databases used by examples, of which some have no schema."""
    used = _examples(spark, sf).select("db_id").distinct()
    return sch.index_statistics(used.join(view(spark, sf, "schema_files"), "db_id", "left"))


def _ddl_folders(spark, sf):
    """A DDL folder per supplier: every seventh file is no UTF-8 text, every fifth folder holds another file only."""
    key = F.regexp_extract("db_id", "([0-9]+)$", 1).cast("long")
    rows = view(spark, sf, "supplier_ddl").withColumn("k", key)
    text = F.when(F.col("k") % 7 == 3, F.concat(F.col("ddl"), F.unhex(F.lit("FFFE20")).cast("string"))).otherwise(F.col("ddl"))
    path = scratch_path(spark, "ddl-folders")
    writers.write_ddl_corpus(rows.where("k % 5 <> 2").select("db_id", text.alias("ddl")), path)
    writers.write_file_per_database(rows.where("k % 5 = 2").select("db_id", F.lit("{}").alias("value")), path, "append", "json")
    return readers.ddl_outcomes(spark, path, "*.txt")


@registered
def d6_schema_rejects(spark, sf):
    """Databases that are not in the index, with the reason; from files."""
    return sch.schema_rejects(_ddl_folders(spark, sf))


@registered
def d7_index_statistics_files(spark, sf):
    """The counters over DDL files of which some are missing and some are no text."""
    return sch.index_statistics(_ddl_folders(spark, sf))


@registered
def d8_cross_reference(spark, sf):
    compared = sch.cross_reference(_schemas(spark, sf), _catalogue(spark, sf))
    return compared.select(
        "db_id", "status", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra")
    )


@registered
def d8_cross_reference_summary(spark, sf):
    return sch.cross_reference_summary(sch.cross_reference(_schemas(spark, sf), _catalogue(spark, sf)))


# ---- example construction ----------------------------------------------------------------------


@registered
def e1_clean_query(spark, sf):
    return _cleaned(spark, sf).select("id", "sql")


@registered
def e2_attach_schema(spark, sf):
    joined = ex.attach_schema(_examples(spark, sf), _schemas(spark, sf))
    return joined.select("id", "db_id", F.length("ddl").alias("ddl_chars"), F.col("ddl").isNull().alias("is_missing"))


@registered
def e3_chat_example(spark, sf):
    chat = ex.convert(_examples(spark, sf), _schemas(spark, sf))
    return chat.select("id", "system", F.md5("user").alias("user_md5"), F.length("user").alias("user_chars"), "assistant")


@registered
def e4_conversion_status(spark, sf):
    return ex.with_status(_examples(spark, sf), _schemas(spark, sf)).select("id", "status")


@registered
def e5_conversion_counts(spark, sf):
    return ex.conversion_counts(_examples(spark, sf), _schemas(spark, sf))


@registered
def e6_construct_report(spark, sf):
    return ex.construct_report(_cleaned(spark, sf).where(F.col("source") == "train"))


@registered
def e7_chat_structure(spark, sf):
    return ex.chat_line_violations(view(spark, sf, "chat_lines"), "line", ["id"])


@registered
def e7_conversation_structure(spark, sf):
    return ex.conversation_violations(table(spark, sf, "conversations"))


# ---- dialect rewrite ---------------------------------------------------------------------------


@registered
def r1_r7_rewrite_query(spark, sf):
    rewritten = rewrite.rewrite_queries(_cleaned(spark, sf))
    return rewritten.select("id", "pg_sql", F.col("pg_sql").contains("||").alias("has_concatenation"))


@registered
def r8_r13_rewrite_ddl(spark, sf):
    return rewrite.rewrite_schemas(_schemas(spark, sf)).select("db_id", "pg_ddl")


@registered
def r8_drop_inserts(spark, sf):
    return rewrite.rewrite_schemas(_schemas(spark, sf), drop_inserts=True).select("db_id", "pg_ddl")


@registered
def r14_rewrite_examples(spark, sf):
    """Native form: schema rewritten once per database, joined last."""
    chat = rewrite.rewrite_examples(_usable(spark, sf), _schemas(spark, sf))
    return chat.select("id", F.md5("user").alias("user_md5"), "assistant")


@registered
def r14_rewrite_chat(spark, sf):
    """Foreign chat rows: the schema is cut out of the message and put back; same result as above."""
    chat = ex.convert(_examples(spark, sf), _schemas(spark, sf)).select("id", *fv.ROLES)
    rewritten = rewrite.rewrite_chat_once(chat, "id")
    return rewritten.select("id", F.md5("new_user").alias("user_md5"), F.col("new_assistant").alias("assistant"), "changed")


@registered
def r15_rewrite_counts(spark, sf):
    """Rewritten examples per source."""
    chat = rewrite.rewrite_queries(_usable(spark, sf))
    return chat.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("sql") != F.col("pg_sql")).alias("n_sql_changed")
    )


@registered
def r16_rewrite_accounting(spark, sf):
    return rewrite.rewrite_accounting(_usable(spark, sf), _schemas(spark, sf))


@registered
def r17_detect_patterns(spark, sf):
    found = dl.detected_patterns(F.col("sql"))
    return _cleaned(spark, sf).select("id", *[col.alias(name) for name, col in found.items()])


@registered
def r17_detect_patterns_ddl(spark, sf):
    found = dl.detected_patterns(F.col("ddl"))
    return _schemas(spark, sf).select("db_id", *[col.alias(name) for name, col in found.items()])


@registered
def r18_residue(spark, sf):
    """Leftover forms in unconverted queries."""
    issues = dl.residue(F.col("sql"))
    return _cleaned(spark, sf).select("id", F.array_join(issues, "|").alias("issues"), (F.size(issues) == 0).alias("is_clean"))


@registered
def r19_residue_before(spark, sf):
    return rewrite.residue_report(_usable(spark, sf), _schemas(spark, sf), "sql", "ddl")


@registered
def r19_residue_after(spark, sf):
    rewritten = rewrite.rewrite_queries(_usable(spark, sf))
    report = rewrite.residue_report(rewritten, rewrite.rewrite_schemas(_schemas(spark, sf)), "pg_sql", "pg_ddl")
    return report.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_issues"), F.count(F.lit(1)).alias("n_kinds"))


@registered
def r20_changed_pairs(spark, sf):
    return rewrite.changed_pairs(rewrite.rewrite_queries(_usable(spark, sf)), "id", n=5)


# ---- features and classes ----------------------------------------------------------------------


@registered
def f1_f7_features(spark, sf):
    upper = F.col(ft.UPPER)
    columns = {**ft.flag_columns(upper), **ft.count_columns(upper)}
    return ft.with_upper(_cleaned(spark, sf)).select("id", *[c.alias(n) for n, c in columns.items()])


@registered
def f8_f9_split_class(spark, sf):
    level = ft.split_class(F.col(ft.UPPER))
    return ft.with_upper(_cleaned(spark, sf)).select("id", level.alias("level"), ft.class_label(level).alias("label"))


@registered
def f10_report_class(spark, sf):
    return ft.with_upper(_cleaned(spark, sf)).select("id", ft.report_label(F.col(ft.UPPER)).alias("label"))


# ---- splits ------------------------------------------------------------------------------------


@registered
def p1_stratified_split(spark, sf):
    split = splits.stratified_split(_labelled(spark, sf), "label", strata_bound=corpus.COMPLEXITY_LABELS)
    return split.select("id", "label", "split")


@registered
def p1_stratified_labels(spark, sf):
    """Split of the labelled documents by quality, three quarters to the first part."""
    return splits.stratified_split(table(spark, sf, "labels"), "quality", "doc_id", ratio=0.75).select(
        "doc_id", "quality", "split"
    )


@registered
def p2_split_statistics(spark, sf):
    return splits.split_statistics(_split(spark, sf))


@registered
def p2_class_counts(spark, sf):
    return splits.class_counts(_split(spark, sf))


@registered
def p3_manifest(spark, sf):
    return splits.manifest(_split(spark, sf))


@registered
def p4_overlaps(spark, sf):
    return splits.overlaps(_split(spark, sf), ["question", "sql"], corpus.SPLITS)


@registered
def p4_document_overlaps(spark, sf):
    """Texts shared between two halves of the documents and the benchmark, compared by digest."""
    documents = table(spark, sf, "documents").select(
        "text", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("validation").alias("split")
    )
    benchmark = table(spark, sf, "benchmark").select("text", F.lit("test").alias("split"))
    return splits.overlaps(documents.unionByName(benchmark), ["text"], corpus.SPLITS, by_digest=True)


_INCREMENT_KEYS = {"text": ["question", "sql"], "db": ["db_id"]}


def _two_batches(spark, sf):
    """The split examples, and the folder of their sketches, added in two batches that hold all rows."""
    rows, path = stage(_split(spark, sf).select("id", "split", "question", "sql", "db_id"), "increments"), scratch_path(spark, "sketches")
    for batch in (0, 1):
        increments.add_batch(rows.where(F.col("id") % 2 == batch), batch, _INCREMENT_KEYS, path)
    return rows, path


@registered
def p4_incremental_overlaps(spark, sf):
    """Leak check of a corpus that grew by two batches: merged sketches, exact counts where they do not prove zero."""
    rows, path = _two_batches(spark, sf)
    found = increments.overlaps(spark, path, "text", _INCREMENT_KEYS["text"], corpus.SPLITS, lambda: rows)
    shared = F.coalesce("exact", F.lit(0))
    return found.select("first", "second", shared.alias("shared"), (F.col("upper") >= shared).alias("within_bound"))


@registered
def t6_incremental_databases(spark, sf):
    """Databases per split from the merged sketches of two batches, exact up to 16,384 of them."""
    _, path = _two_batches(spark, sf)
    return increments.merged(spark, path).where("name = 'db'").select("split", F.col("n").alias("n_databases"))


@registered
def p5_drift(spark, sf):
    return splits.drift(splits.class_counts(_split(spark, sf))).select(F.round("max_diff", 6).alias("max_diff"))


@registered
def p6_split_gate(spark, sf):
    return corpus.gate(_split(spark, sf), "sql")


# ---- statistics --------------------------------------------------------------------------------


@registered
def t1_sections(spark, sf):
    """Schema, question and database read back out of user messages."""
    chat = ex.convert(_examples(spark, sf), _schemas(spark, sf))
    user = F.col("user")
    return chat.select(
        "id", F.md5(st.schema_section(user)).alias("schema_md5"), st.question_section(user).alias("question"),
        st.database_section(user).alias("db_id"),
    )


@registered
def t2_document_lengths(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.length(text).alias("n_chars"), token_count(text).alias("n_tokens"))


@registered
def t3_document_distribution(spark, sf):
    lengths = table(spark, sf, "documents").select(
        "lang", *[c.alias(n) for n, c in stats.length_columns({"text": F.col("text")}).items()]
    )
    return stats.distribution(lengths, "lang", ["text_chars", "text_tokens"])


@registered
def t3_text_distribution(spark, sf):
    """All six text distributions per source; schema text counted per example that carries it. An empty source has zeros."""
    usable = _usable(spark, sf).withColumn("split", F.col("source"))
    return stats.with_expected(stats.text_distribution(usable, _schemas(spark, sf)), "split", ("train", "dev", "held back"))


@registered
def t4_feature_counts(spark, sf):
    return stats.feature_counts(_split(spark, sf))


@registered
def t5_report_classes(spark, sf):
    return stats.report_classes(_split(spark, sf))


@registered
def t6_distinct_databases(spark, sf):
    return stats.distinct_databases(_split(spark, sf))


@registered
def t7_totals(spark, sf):
    return stats.example_totals(_split(spark, sf))


@registered
def t7_full_report(spark, sf):
    """Every statistic of every source as long rows."""
    usable = _usable(spark, sf).withColumn("split", F.col("source"))
    return stats.full_report(usable, _schemas(spark, sf))


# ---- model input -------------------------------------------------------------------------------


@registered
def i1_render_conversations(spark, sf):
    return model_input.render_conversations(table(spark, sf, "conversations")).select("conv_id", "text")


@registered
def i1_render_messages(spark, sf):
    chat = ex.chat_rows(ex.convert(_examples(spark, sf), _schemas(spark, sf)), "id")
    return model_input.render_messages(chat, "id").select("id", F.md5("text").alias("text_md5"))


@registered
def i2_prompts(spark, sf):
    return model_input.render_conversations(table(spark, sf, "conversations")).select("conv_id", "prompt")


@registered
def i2_demo_prompts(spark, sf):
    """Demo prompts for all examples; a blank query stands in for a blank question here."""
    requests = ex.attach_schema(_examples(spark, sf), _schemas(spark, sf)).select(
        "id", F.col("ddl").alias("schema"), F.col("query").alias("question")
    )
    return model_input.demo_prompts(requests).select("id", F.md5("prompt").alias("prompt_md5"), "is_error")


@registered
def i3_sequence_budget(spark, sf):
    rendered = model_input.render_conversations(table(spark, sf, "conversations"))
    return model_input.sequence_budget(rendered, 200).drop("system", "user", "assistant", "prompt", "text")


@registered
def i3_budget_summary(spark, sf):
    budget = model_input.example_budget(_usable(spark, sf), _schemas(spark, sf), max_length=60)
    return model_input.budget_summary(budget)


@registered
def i3_model_tensors(spark, sf):
    """Input ids, attention mask and labels of every conversation, 64 tokens long; ids by falling token frequency."""
    rendered = model_input.render_conversations(table(spark, sf, "conversations")).select("conv_id", "text")
    tensors = model_input.model_tensors(rendered, model_input.token_dictionary(rendered), "conv_id", max_length=64)
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ").alias(c)
    return tensors.select("conv_id", joined("input_ids"), joined("attention_mask"), joined("labels"))


@registered
def i4_load_training_data(spark, sf):
    """Chat files of both sides, read by the tolerant reader and rendered."""
    path = scratch_path(spark, "chat")
    chat = ex.convert(_examples(spark, sf), _schemas(spark, sf)).withColumn("split", F.when(F.col("source") == "dev", "validation").otherwise("train"))
    writers.write_chat(chat.select("split", "system", "user", "assistant"), path)
    sides = ("train", "validation")
    read = [readers.read_jsonl_tolerant(spark, f"{path}/split={side}")[0] for side in sides]
    loaded = model_input.load_training_data(*read, [])
    rows = [df.select(F.lit(side).alias("side"), F.length("text").alias("n"), F.md5("text").alias("m")) for side, df in zip(sides, loaded, strict=True)]
    return rows[0].unionByName(rows[1]).groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("chars"), F.max("m").alias("last_md5"))


@registered
def i4_training_text(spark, sf):
    """Both sources rewritten and budgeted: rows, tokens and truncated rows per source."""
    rewritten = rewrite.rewrite_queries(_usable(spark, sf))
    budget = model_input.example_budget(
        rewritten, rewrite.rewrite_schemas(_schemas(spark, sf)), "pg_ddl", "pg_sql", max_length=60
    )
    return budget.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("n_tokens"), F.count_if("truncated").alias("n_truncated")
    )


# ---- scoring -----------------------------------------------------------------------------------


@registered
def x1_seeded_sample(spark, sf):
    return scoring.seeded_sample(_examples(spark, sf)).select("id", "query")


@registered
def x2_completions(spark, sf):
    text = F.col("generated")
    return view(spark, sf, "predictions").select(
        "id", st.completion(text).alias("completion"), st.demo_completion(text).alias("demo_completion")
    )


@registered
def x3_normalise(spark, sf):
    return _examples(spark, sf).select("id", st.normalise_query(F.col("query")).alias("normalised"))


def _scored(spark, sf):
    references = _labelled(spark, sf).select(
        "id", "label", F.col("query").alias("reference"), F.concat_ws(" ", *["question"] * 8).alias("prompt")
    )
    return scoring.score(references, view(spark, sf, "predictions"))


@registered
def x4_exact_match(spark, sf):
    return _scored(spark, sf).select("id", "exact_match")


@registered
def x5_accuracy(spark, sf):
    return scoring.accuracy(_scored(spark, sf))


@registered
def x5_accuracy_per_class(spark, sf):
    scored = scoring.accuracy(_scored(spark, sf), "label")
    return scored.withColumn("exact_match_accuracy", F.round("exact_match_accuracy", 6))


@registered
def x5_report_records(spark, sf):
    return scoring.report_records(_scored(spark, sf))


@registered
def x6_perplexity(spark, sf):
    result = scoring.perplexity(view(spark, sf, "trainlog"), "loss", "run_id")
    return result.select("run_id", F.round("perplexity", 6).alias("perplexity"))


# ---- training log, roll-up, catalogue ----------------------------------------------------------


@registered
def l1_progress(spark, sf):
    return trainlog.progress(view(spark, sf, "trainlog")).drop("ts", "loss")


@registered
def l2_plateau(spark, sf):
    result = trainlog.plateau(view(spark, sf, "trainlog"))
    return result.withColumn("best_loss", F.round("best_loss", 9))


@registered
def l2_plateau_stream(spark, sf):
    """The runs told to stop by a stream of three batches, whose evaluations are up to 600 seconds late."""
    log = view(spark, sf, "trainlog")
    last = log.agg(F.max("step")).first()[0] or 0
    arrival = F.col("step") + F.pmod(F.xxhash64("step"), F.lit(600))
    batch = F.least(F.lit(2), F.floor(arrival * 3 / (last + 1)))
    timed = log.select("run_id", "step", F.timestamp_seconds("step").alias("ts"), "loss", batch.alias("batch"))
    verdicts = late_plateau.replay(spark, [timed.where(F.col("batch") == i) for i in range(3)], lateness="601 seconds")
    return verdicts.where("should_stop").select("run_id", F.col("step").alias("stop_step"), F.round("best_loss", 9).alias("best_loss"), "wait_count")


@registered
def l2_plateau_patient(spark, sf):
    """A patient detector with a large step, so that some runs end without firing."""
    result = trainlog.plateau(view(spark, sf, "trainlog"), patience=60, min_delta=0.5)
    return result.withColumn("best_loss", F.round("best_loss", 9))


@registered
def l3_check_roll_up(spark, sf):
    """Field check, structure check, split gate and residue of whole tables in one table."""
    fields = checks.field_check(checks.with_missing_fields(view(spark, sf, "raw_lines"), "line"))
    broken = ex.chat_line_violations(view(spark, sf, "chat_lines"), "line", ["id"]).agg(F.count(F.lit(1)).alias("n"))
    counted = F.col("n").cast("string")
    residue = (
        rewrite.rewrite_queries(_cleaned(spark, sf))
        .agg(F.count_if(~dl.is_clean(F.col("pg_sql"))).alias("n"))
    )
    return checks.roll_up(
        [
            checks.check_row(fields, "required_fields", F.col("invalid") == 0, F.col("status")),
            checks.check_row(broken, "chat_structure", F.col("n") == 0, counted),
            checks.check_row(residue, "residue", F.col("n") == 0, counted),
            corpus.gate(_split(spark, sf), "sql"),
        ]
    )


@registered
def g1_catalogue_questions(spark, sf):
    catalogue = view(spark, sf, "demo_catalogue").select("name", F.array("q1", "q2").alias("sample_questions"))
    return sch.catalogue_questions(catalogue)


@registered
def g2_catalogue_check(spark, sf):
    """Dialect rules on the schemas before and after the rewrite."""
    rewritten = rewrite.rewrite_schemas(_schemas(spark, sf))
    before = sch.catalogue_check(rewritten).withColumn("stage", F.lit("before"))
    after = sch.catalogue_check(rewritten.select("db_id", F.col("pg_ddl").alias("ddl"))).withColumn("stage", F.lit("after"))
    return before.unionByName(after)
