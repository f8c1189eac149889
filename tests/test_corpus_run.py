"""The whole run on the given tables."""

import json

from sqlcorpus.operators import stats
from sqlcorpus.operators.examples import usable
from sqlcorpus.plans import corpus
from sqlcorpus.registry.derived import schemas as schemas_of
from sqlcorpus.registry.derived import view
from sqlcorpus.session import scratch_root


def test_run_and_write(spark, sf, tmp_path):
    examples, schemas = view(spark, sf, "examples"), schemas_of(spark, sf)
    result = corpus.run(examples, schemas)
    n = usable(examples, schemas).count()
    assert result.examples.count() == n
    counts = {r.split: r.value for r in result.manifest.where("metric = 'n_rows'").collect()}
    assert sum(counts.values()) == n and set(counts) == set(corpus.SPLITS)
    per_class = {
        (r.split, r.metric): r.value for r in result.manifest.where("metric LIKE 'class:%'").collect() if r.split != "train"
    }
    for (_, metric), value in per_class.items():
        other = [v for (_, m), v in per_class.items() if m == metric]
        assert max(other) - min(other) <= 1 and value in other
    assert result.accounting.first().total_examples == n
    verdict = {r.check_name: r.passed for r in result.checks.collect()}
    assert verdict["residue"] and verdict["distribution"]
    assert verdict["all_passed"] == all(passed for name, passed in verdict.items() if name != "all_passed")
    result.write(str(tmp_path / "out"))
    files = list((tmp_path / "out" / "chat" / "split=test").glob("*.json"))
    lines = [json.loads(line) for f in files for line in f.read_text().splitlines()]
    assert len(lines) == counts["test"]
    assert all([m["role"] for m in row["messages"]] == ["system", "user", "assistant"] for row in lines)
    assert not any("PRAGMA" in row["messages"][1]["content"] for row in lines)
    written = spark.read.json(str(tmp_path / "out" / "statistics"))
    assert written.where("section = 'totals' AND name = 'examples' AND split IS NULL").first().value == n
    nested = {r.split: json.loads(r.report) for r in stats.report_json(result.statistics).collect()}
    assert nested["train"]["totals"]["examples"]["n"] == counts["train"] and nested[None]["totals"]["examples"]["n"] == n


def test_scratch_is_the_configured_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_root(spark) == (configured or spark.conf.get("spark.checkpoint.dir")).rstrip("/")


def test_no_source_is_lost(spark):
    from sqlcorpus.plans.corpus import final_splits

    rows = spark.createDataFrame([(i, ("train", "dev", "others")[i % 3], "simple") for i in range(60)], "id long, source string, label string")
    counts = {r.split: r["count"] for r in final_splits(rows).groupBy("split").count().collect()}
    assert counts == {"train": 20, "validation": 10, "test": 10, "other": 20}


def test_gate_counts_other_sources(spark):
    rows = [("train", "a"), ("validation", "b"), ("test", "c"), ("other", "b"), ("other", "c"), ("other", "d"), ("test", "d")]
    data = spark.createDataFrame([(s, q, "SELECT 1", "simple") for s, q in rows], "split string, question string, pg_sql string, label string")
    got = {r.check_name: r.message for r in corpus.gate(data).collect()}
    assert (got["other_val_overlap"], got["other_test_overlap"]) == ("1 shared (warning)", "2 shared (warning)")
    assert not any(r.check_name.startswith("other") for r in corpus.gate(data.where("split <> 'other'")).collect())
