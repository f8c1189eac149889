"""Readers and writers on real files."""

import json

import pytest
from pyspark.sql import functions as F

from sqlcorpus.operators import checks, schemas as sch
from sqlcorpus.sources import readers, writers


def test_example_array(spark, tmp_path):
    rows = [
        {"question": "q é", "query": "SELECT 1", "db_id": "d", "question_toks": ["q"]},
        {"question": "only", "extra": [1]},
    ]
    path = tmp_path / "dev.json"
    path.write_text(json.dumps(rows, indent=2, ensure_ascii=False), encoding="utf-8")
    out = readers.read_example_array(spark, str(path)).orderBy("question").collect()
    assert [(r.db_id, r.question, r.query, r.question_toks) for r in out] == [("", "only", "", None), ("d", "q é", "SELECT 1", ["q"])]
    assert readers.read_example_array_or_none(spark, str(tmp_path / "none.json")) is None
    assert readers.read_example_array_or_none(spark, str(path)).count() == 2


def test_broken_array_fails(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"question": "q"')
    with pytest.raises(Exception):
        readers.read_example_array(spark, str(tmp_path / "x.json")).collect()


CHAT = '{"messages": [{"role": "user", "content": "%s"}]}'


def test_strict_jsonl(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text("\n".join(CHAT % i for i in range(5)) + "\n")
    assert readers.read_jsonl(spark, str(good)).count() == 5
    bad = tmp_path / "bad.jsonl"
    bad.write_text((CHAT % 1) + "\nnope\n")
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(bad)).collect()


def test_tolerant_jsonl_with_line_numbers(spark, tmp_path):
    lines = []
    for i in range(1, 2001):
        lines.append("" if i % 50 == 0 else "{broken" if i % 33 == 0 else "  " + CHAT % i)
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text("nope\n" + CHAT % "b" + "\n")
    broken_at = [i for i in range(1, 2001) if i % 33 == 0 and i % 50]
    # tiny splits: several blocks of one file are read by different tasks
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        good, bad = readers.read_jsonl_tolerant(spark, str(tmp_path))
        found = {}
        for r in bad.collect():
            found.setdefault(r.file.rsplit("/", 1)[1], []).append(r.line_number)
        assert good.count() == sum(1 for x in lines if x.strip().startswith('{"')) + 1
        assert good.rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(found["a.jsonl"]) == broken_at and found["b.jsonl"] == [1]


def test_tolerant_stops_after_max_samples(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(["x", CHAT % 1, "", "y", CHAT % 2, "z", CHAT % 3]))
    good, bad = readers.read_jsonl_tolerant(spark, str(tmp_path), max_samples=2)
    assert [r.messages[0].content for r in good.collect()] == ["1", "2"]
    assert sorted(r.line_number for r in bad.collect()) == [1, 4]
    good, bad = readers.read_jsonl_tolerant(spark, str(tmp_path), max_samples=99)
    assert good.count() == 3 and sorted(r.line_number for r in bad.collect()) == [1, 4, 6]


def test_ddl_corpus(spark, tmp_path):
    for name, ddl in (("shop", "CREATE TABLE t (\na int\n);\n"), ("bank", "x")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "schema.sql").write_text(ddl)
        (tmp_path / name / f"{name}.sqlite").write_bytes(b"0")
    (tmp_path / "gap").mkdir()
    (tmp_path / "gap" / "other.txt").write_text("x")
    out = {r.db_id: r.ddl for r in readers.read_ddl_corpus(spark, str(tmp_path)).collect()}
    assert out == {"shop": "CREATE TABLE t (\na int\n);\n", "bank": "x"}
    assert [r.db_id for r in readers.ddl_corpus_gaps(spark, str(tmp_path)).collect()] == ["gap"]
    files = readers.list_files(spark, str(tmp_path))
    assert checks.database_coverage(files, 2).first().passed
    assert "content" not in files.columns


def test_manifest_of_files(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text("a\nb\n\n")
    files = readers.list_files(spark, str(tmp_path), "*.jsonl").join(readers.line_counts(spark, str(tmp_path)), "name")
    expected = spark.createDataFrame([("train.jsonl",), ("val.jsonl",)], "name string")
    rows = {r.name: (r.present, r.examples) for r in checks.manifest_check(expected, files).collect()}
    assert rows == {"train.jsonl": (True, 3), "val.jsonl": (False, 0)}


def test_catalogues(spark, tmp_path):
    tables = tmp_path / "tables.json"
    tables.write_text(json.dumps([{"db_id": "d", "table_names_original": ["A", "b"], "column_types": ["x"]}]))
    assert [tuple(r) for r in readers.read_catalogue(spark, str(tables)).collect()] == [("d", ["A", "b"])]
    (tmp_path / "ddl").mkdir()
    (tmp_path / "ddl" / "shop.sql").write_text("CREATE TABLE t (id SERIAL, u int REFERENCES u(id));")
    demo = {
        "shop": {"schema_file": "data/shop.sql", "name": "Shop", "description": "d", "tables": ["t"], "sample_questions": ["a", "b"]},
        "lost": {"schema_file": "data/lost.sql", "name": "Lost", "description": "d", "tables": [], "sample_questions": ["c"]},
        "_metadata": {"created_at": "now"},
    }
    (tmp_path / "demo.json").write_text(json.dumps(demo))
    rows = readers.read_demo_catalogue(spark, str(tmp_path / "demo.json"), str(tmp_path / "ddl"))
    assert {r.name for r in rows.collect()} == {"shop", "lost"}
    assert [r.question for r in sch.catalogue_questions(rows, "shop").collect()] == ["a", "b"]
    found = sch.catalogue_check(rows.select(F.col("name").alias("db_id"), "ddl")).collect()
    assert [tuple(r) for r in found] == [("lost", "File not found")]
    writers.write_demo_catalogue(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_jsonl_keeps_text_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([("train", "é漢", None)], "split string, a string, b string")
    writers.write_jsonl(df, str(tmp_path / "o"), "split", keep_nulls=True)
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "o" / "split=train").glob("*.json"))
    assert text == '{"a":"é漢","b":null}\n'


def test_report_is_one_file(spark, tmp_path):
    writers.write_report(spark.createDataFrame([("x", None)], "m string, v double"), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("*.json"))) == 1


def test_folder_names_keep_their_plus(spark, tmp_path):
    for name in ("c++_db", "a b", "x%y"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "schema.sql").write_text("CREATE TABLE t (id INT);")
    (tmp_path / "no+ddl").mkdir()
    (tmp_path / "no+ddl" / "other.txt").write_text("x")
    assert {r.db_id for r in readers.read_ddl_corpus(spark, str(tmp_path)).collect()} == {"c++_db", "a b", "x%y"}
    assert [r.db_id for r in readers.ddl_corpus_gaps(spark, str(tmp_path)).collect()] == ["no+ddl"]


ODD_LINES = {
    '{"a": 1} garbage': False,
    '{"a": 1}{"a": 2}': False,
    '{"a": 1}, {"a": 2}': False,
    '{"a": 1}], [': False,
    '{"a": 1, "a": 2}': True,
    '{"a": NaN}': True,
    "{'a': 1}": False,
    '{"a": "cut': False,
    "null": True,
}


def test_a_line_is_exactly_one_value(spark):
    lines = spark.createDataFrame([(k,) for k in ODD_LINES], "line string")
    found = readers.classify_lines(lines).collect()
    assert {r.line: r.line_status == "ok" for r in found} == ODD_LINES


@pytest.mark.parametrize("line", [k for k, good in ODD_LINES.items() if not good])
def test_strict_reader_takes_one_value_a_line(spark, tmp_path, line):
    path = tmp_path / "odd.jsonl"
    path.write_text(line + "\n", encoding="utf-8")
    with pytest.raises(Exception, match="exactly one JSON value"):
        readers.read_jsonl(spark, str(path), "a int").collect()


def test_very_long_texts(spark, tmp_path):
    path = tmp_path / "long.jsonl"
    row = {"messages": [{"role": "user", "content": "x" * 20_500_000}]}
    path.write_text(json.dumps(row) + "\n", encoding="utf-8")
    size = "length(messages[0].content) AS n"
    good, broken = readers.read_jsonl_tolerant(spark, str(path))
    assert good.selectExpr(size).first().n == 20_500_000 and broken.count() == 0
    assert readers.read_jsonl(spark, str(path)).selectExpr(size).first().n == 20_500_000
    path.write_text(json.dumps([{"db_id": "d", "question": "x" * 20_500_000}]), encoding="utf-8")
    assert readers.read_example_array(spark, str(path)).selectExpr("length(question) AS n").first().n == 20_500_000


def test_one_row_per_database(spark, tmp_path):
    for root in ("a", "b"):
        (tmp_path / root / "shop").mkdir(parents=True)
        (tmp_path / root / "shop" / "schema.sql").write_text(f"-- {root}", encoding="utf-8")
    assert [tuple(r) for r in readers.read_ddl_corpus(spark, str(tmp_path)).collect()] == [("shop", "-- b")]


def test_broken_array_file_gives_a_reject_row(spark, tmp_path):
    folder = tmp_path / "arrays"
    folder.mkdir()
    (folder / "a.json").write_text('[{"db_id": "d", "question": "q", "query": "SELECT 1"},\n {"db_id": "e"}]')
    (folder / "b.json").write_text('[{"db_id": "d", "question": "q"')
    (folder / "c.json").write_text("[]")
    good, rejects = readers.read_example_files(spark, str(folder))
    assert sorted((r.db_id, r.question, r.query) for r in good.collect()) == [("d", "q", "SELECT 1"), ("e", "", "")]
    assert [(r.file.rsplit("/", 1)[1], r.reason) for r in rejects.collect()] == [("b.json", "invalid JSON")]


def test_ddl_outcomes_tell_missing_from_unreadable(spark, tmp_path):
    from sqlcorpus.operators import schemas as sch
    from sqlcorpus.plans.corpus import reject_rows

    for name, file, body in (("ok", "schema.sql", "CREATE TABLE é (a int);".encode()), ("bad", "schema.sql", b"CREATE \xff\xfe"), ("none", "other.txt", b"x")):
        (tmp_path / name).mkdir()
        (tmp_path / name / file).write_bytes(body)
    outcomes = readers.ddl_outcomes(spark, str(tmp_path))
    assert {r.db_id: (r.ddl, r.error) for r in outcomes.collect()} == {
        "ok": ("CREATE TABLE é (a int);", None), "bad": (None, "not UTF-8"), "none": (None, None)}
    row = sch.index_statistics(outcomes).first()
    assert (row.total_found, row.schema_files_found, row.successfully_parsed, row.missing_schema, row.parse_errors) == (3, 2, 1, 1, 1)
    errors = spark.createDataFrame([("dev", "File not found: dev")], "source string, error string")
    assert {tuple(r) for r in reject_rows(outcomes, errors).collect()} == {
        ("schema", "bad", "not UTF-8"), ("schema", "none", "missing schema"), ("source", "dev", "File not found: dev")}


def array_text(rng, n):
    """A random array of objects: braces, quotes and backslashes in texts, inner objects and lists, any white space."""
    pieces = ["}", "{", '"', "\\", "[", "]", ",", "},{", '\\"}', "é", "\n", " ", "x", "日本", ""]
    text = lambda: "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))
    rows = []
    for i in range(n):
        row = {"db_id": f"d{i}", "question": text(), "query": text()}
        if rng.random() < 0.3:
            row["question_toks"] = [text() for _ in range(3)]
        if rng.random() < 0.3:
            row["sql"] = {"a": {text(): [1, {"b": text()}]}, "c": {}}
        rows.append(row)
    return json.dumps(rows, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n"])


def test_one_array_file_is_read_by_several_tasks(spark, tmp_path):
    """Blocks of a few hundred bytes begin anywhere: in strings, in inner objects, behind a backslash."""
    import random

    from sqlcorpus.sources import arrays

    rng, key = random.Random(5), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    (tmp_path / "many").mkdir()
    want = []
    for k in range(4):
        body = array_text(rng, (60, 0, 1, 12)[k])
        (tmp_path / "many" / f"{k}.json").write_text(body, encoding="utf-8")
        want += [(f"{k}.json", r["db_id"], r["question"], r["query"], r.get("question_toks")) for r in json.loads(body)]
    try:
        for size in ("299", before):
            spark.conf.set(key, size)
            good, rejects = readers.read_example_files(spark, str(tmp_path / "many"))
            got = [(r.file.rsplit("/", 1)[1], r.db_id, r.question, r.query, r.question_toks) for r in good.collect()]
            assert sorted(got, key=str) == sorted(want, key=str) and rejects.count() == 0
        spark.conf.set(key, "1500")
        fragments = arrays._fragments(spark, str(tmp_path / "many" / "0.json"))
        assert fragments.rdd.getNumPartitions() > 4
        assert sorted(map(str, readers.read_example_array(spark, str(tmp_path / "many" / "0.json")).collect())) == sorted(
            map(str, spark.read.schema(readers.EXAMPLE).option("multiLine", True).json(str(tmp_path / "many" / "0.json")).collect()))
    finally:
        spark.conf.set(key, before)


def test_broken_arrays_of_every_kind(spark, tmp_path):
    bodies = {
        "cut": '[{"db_id": "a"}, {"db_id": "b', "open": '[{"db_id": "a"}', "comma": '[{"db_id": "a"},]', "two": '[{"db_id": "a"}] [{"db_id": "b"}]',
        "scalar": '[{"db_id": "a"}, 5]', "inner": '[[{"db_id": "a"}]]', "object": '{"db_id": "a"}', "behind": '[{"db_id": "a"}] x', "none": "nothing",
        "missing": '[{"db_id": "a"} {"db_id": "b"}]', "closed": '[{"db_id": "a"}}]', "quote": '[{"db_id": "a"}, {"db_id": "b" "c": 1}]', "blank": " \n",
        "bytes": b'[{"db_id": "a\xff"}]', "good": '\n[ {"db_id": "a"}\t,\r\n{"db_id": "{]}"} ]\n', "empty": " [ ] ",
    }
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_bytes(body if isinstance(body, bytes) else body.encode())
    good, rejects = readers.read_example_files(spark, str(tmp_path))
    assert sorted((r.file.rsplit("/", 1)[1], r.db_id) for r in good.collect()) == [("good.json", "a"), ("good.json", "{]}")]
    assert sorted(r.file.rsplit("/", 1)[1] for r in rejects.collect()) == sorted(f"{n}.json" for n in bodies if n not in ("good", "empty"))
