"""Training-log operators against a plain walk, in batch and in streaming form."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sqlcorpus.operators import trainlog


def walk(points, patience, min_delta):
    best, wait = None, 0
    for step, value in points:
        if value is None:
            continue
        if best is None or value < best - min_delta:
            best, wait = value, 0
        else:
            wait += 1
            if wait >= patience:
                return step, best, wait
    return None, best, wait


def make_log(seed, runs=25, steps=120):
    rng = random.Random(seed)
    rows = []
    for run in range(runs):
        level = rng.uniform(0.5, 5)
        for step in range(rng.randint(1, steps)):
            level -= rng.choice([0, 0, 0.005, 0.02, 0.2])
            rows.append((run, step * 3, None if rng.random() < 0.05 else level + rng.choice([0, 0.01, 0.3])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("patience,min_delta", [(3, 0.01), (1, 0.5), (10, 0.001), (40, 1.0)])
@pytest.mark.parametrize("chunk", [7, 10_000])
def test_plateau_equals_walk(spark, monkeypatch, patience, min_delta, chunk):
    monkeypatch.setattr(trainlog, "STEPS_PER_CHUNK", chunk)
    rows = make_log(patience)
    expected = {}
    by_run = defaultdict(list)
    for run, step, value in sorted(rows, key=lambda r: r[:2]):
        by_run[run].append((step, value))
    for run, points in by_run.items():
        if any(v is not None for _, v in points):
            expected[run] = walk(points, patience, min_delta)
    log = spark.createDataFrame(rows, "run_id long, step long, loss double")
    out = {r.run_id: (r.stop_step, r.best_loss, r.wait_count) for r in trainlog.plateau(log, patience=patience, min_delta=min_delta).collect()}
    assert out == expected


def test_only_a_bounded_head_is_gathered(spark, monkeypatch):
    """A flat run of 50,000 steps fires at once; its tail never reaches the fold."""
    monkeypatch.setattr(trainlog, "STEPS_PER_CHUNK", 100)
    log = spark.range(50_000).selectExpr("1L AS run_id", "id AS step", "1.0D AS loss")
    row = trainlog.plateau(log).first()
    assert (row.stop_step, row.best_loss, row.wait_count, row.evaluations) == (3, 1.0, 3, 50_000)


def test_a_falling_run_is_composed_of_chunks(spark, monkeypatch):
    """30,000 falling evaluations never stop and then stay flat: every chunk is needed, none is gathered with another."""
    monkeypatch.setattr(trainlog, "STEPS_PER_CHUNK", 1000)
    log = spark.range(30_010).selectExpr("1L AS run_id", "id AS step", "-CAST(least(id, 30000) AS DOUBLE) AS loss")
    row = trainlog.plateau(log, patience=4).first()
    assert (row.stop_step, row.best_loss, row.wait_count, row.evaluations) == (30_004, -30_000.0, 4, 30_010)


def test_entries_of_a_chunk_are_bounded(spark):
    series = F.array(*[F.struct(F.lit(i).cast("long").alias("step"), F.lit(float(-i)).alias("value")) for i in range(50)])
    entries = spark.range(1).select(trainlog._entries(series, 3, 0.01).alias("e")).first().e
    assert [(e.at, e.step, e.then.best, e.then.wait, e.then.stop_step) for e in entries] == [(i, i, -49.0, 0, None) for i in range(3)]


def test_nan_first_value_never_improves(spark):
    log = spark.createDataFrame([(1, i, float("nan") if i == 0 else 1.0) for i in range(6)], "run_id long, step long, loss double")
    row = trainlog.plateau(log).first()
    assert row.stop_step == 3 and row.best_loss != row.best_loss


def test_min_delta_must_be_positive(spark):
    with pytest.raises(ValueError):
        trainlog.plateau(spark.createDataFrame([(1, 1, 1.0)], "run_id long, step long, loss double"), min_delta=0)


def test_progress(spark):
    start = datetime(2024, 1, 31, 23, 59, 50)
    rows = [(1, step, start + timedelta(seconds=10 * i, microseconds=500_000 * i)) for i, step in enumerate([0, 25, 100])]
    log = spark.createDataFrame(rows, "run_id long, step long, ts timestamp_ntz")
    out = {r.step: (r.progress_pct, r.elapsed_s, r.remaining_s) for r in trainlog.progress(log).collect()}
    assert out == {0: (0.0, 0.0, None), 25: (25.0, 10.5, 31.5), 100: (100.0, 21.0, 0.0)}
    runs = spark.createDataFrame([(1, start, 200)], "run_id long, started timestamp_ntz, total_steps long")
    planned = {r.step: r.progress_pct for r in trainlog.progress(log, runs).collect()}
    assert planned == {0: 0.0, 25: 12.5, 100: 50.0}


def test_watching_a_stream_equals_walk(spark, tmp_path):
    from sqlcorpus.streaming.plateau import watch_plateau

    rows = sorted(make_log(5, runs=6, steps=40), key=lambda r: r[1])
    source = tmp_path / "in"
    schema = "run_id long, step long, loss double"
    for part in range(3):  # files arrive in step order
        chunk = [r for r in rows if part * 40 <= r[1] < (part + 1) * 40]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = (
        watch_plateau(stream).writeStream.format("memory").queryName("verdicts").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    stops = {r.run_id: r.step for r in spark.sql("SELECT * FROM verdicts WHERE should_stop").collect()}
    by_run = defaultdict(list)
    for run, step, value in sorted(rows, key=lambda r: r[:2]):
        by_run[run].append((step, value))
    expected = {run: walk(points, 3, 0.01)[0] for run, points in by_run.items()}
    assert stops == {run: step for run, step in expected.items() if step is not None} and stops


def test_landing_stream_rewrites_and_keeps_broken_lines(spark, tmp_path):
    import json

    from sqlcorpus.streaming.landing import read_landing, start_rewrite

    def chat(sql):
        user = "Database: d\n\nSchema:\nPRAGMA x;\nCREATE TABLE t (a BLOB);\n\nQuestion: q\n\nGenerate the SQL query:"
        roles = [("system", "s"), ("user", user), ("assistant", sql)]
        return json.dumps({"messages": [{"role": r, "content": c} for r, c in roles]})

    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.jsonl").write_text(chat("SELECT DATE('now')") + "\n\nbroken\n")
    (landing / "b.jsonl").write_text(chat("SELECT 1") + "\n")
    lines = read_landing(spark, str(landing), 1)
    start_rewrite(lines, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp")).awaitTermination(120)
    out = [[m.content for m in r.messages] for r in spark.read.json(str(tmp_path / "out")).collect()]
    assert sorted(m[2] for m in out) == ["SELECT 1", "SELECT CURRENT_DATE"]
    assert all("PRAGMA" not in m[1] and "BYTEA" in m[1] for m in out)
    assert [r.line for r in spark.read.schema("file string, line string").json(str(tmp_path / "bad")).collect()] == ["broken"]


def test_long_lines_of_the_stream_are_not_lost(spark, tmp_path):
    """A chat line longer than the parser's usual limit of 20,000,000 characters comes out whole."""
    import json

    from sqlcorpus.streaming.landing import split_lines

    text = "x" * 21_000_000
    line = json.dumps({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": text}, {"role": "assistant", "content": "a"}]})
    (tmp_path / "long.jsonl").write_text(line + "\nbroken\n")
    lines = spark.read.text(str(tmp_path)).selectExpr("'f' AS file", "value AS line")
    chat, broken = split_lines(lines)
    assert [tuple(r) for r in chat.selectExpr("length(system)", "length(user)", "length(assistant)").collect()] == [(1, 21_000_000, 1)]
    assert broken.count() == 1


def test_stream_and_batch_agree_on_nan_and_null(spark, tmp_path):
    from sqlcorpus.streaming.plateau import watch_plateau

    nan = float("nan")
    series = {1: [1.0, nan, nan, nan, 0.5], 2: [nan, 1.0, 0.5, 0.2, 0.1], 3: [1.0, None, None, None, 0.5, 0.4], 4: [1.0, nan, 0.5, nan, None, 0.5]}
    rows = [(run, step, v) for run, values in series.items() for step, v in enumerate(values)]
    schema = "run_id long, step long, loss double"
    log = spark.createDataFrame(rows, schema)
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = (
        watch_plateau(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("nan_verdicts")
        .outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    stops = {r.run_id: r.step for r in spark.sql("SELECT * FROM nan_verdicts WHERE should_stop").collect()}
    batch = {r.run_id: r.stop_step for r in trainlog.plateau(log).collect() if r.stop_step is not None}
    assert stops == batch == {1: 3, 2: 3}
