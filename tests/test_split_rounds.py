"""Radix selection of the cut in several rounds, and the gate from one scan."""

import random

import pytest

from sqlcorpus import fixed_values as fv
from sqlcorpus.operators import splits
from sqlcorpus.plans import corpus
from tests.test_splits_and_stats import brute_force_split

NAMES = ("A", "B")
LABELS = [*fv.CLASS_LABELS.values(), fv.UNKNOWN_LABEL]


@pytest.mark.parametrize("ratio", [0.0, 0.3, 0.5, 1.0])
@pytest.mark.parametrize("digits, bound", [(1, 1), (1, 5), (2, 3)])
def test_rounds_equal_brute_force(spark, ratio, digits, bound):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a"] * 9 + ["b", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, label string")
    out = splits.stratified_split(df, "label", ratio=ratio, digits=digits, ranked_bound=bound, names=NAMES).collect()
    assert len(out) == len(rows)
    assert {r.id for r in out if r.split == "A"} == brute_force_split(rows, ratio)


def test_a_repeated_id_is_ranked_once(spark):
    """A third of all rows has one id: no digits part them, and they stay together."""
    rows = [(7, "a")] * 300 + [(i, "a") for i in range(1000, 1600)]
    df = spark.createDataFrame(rows, "id long, label string")
    for ratio in (0.2, 0.5, 0.8):
        out = splits.stratified_split(df, "label", ratio=ratio, digits=8, ranked_bound=10, names=NAMES).collect()
        assert len(out) == 900
        assert {r.id for r in out if r.split == "A"} == brute_force_split(rows, ratio)


def test_empty_rows_have_no_cut(spark):
    df = spark.createDataFrame([], "id long, label string")
    assert splits.stratified_split(df, "label", ranked_bound=1).collect() == []


def split_rows(rng, with_other):
    names = ["train", "validation", "test"] + ["other"] * with_other
    return [(rng.choice(names), f"q{rng.randrange(60)}", rng.choice(["s", "t", None]), rng.choice([*LABELS, "simple"])) for _ in range(500)]


@pytest.mark.parametrize("with_other", [False, True])
def test_gate_in_one_pass_equals_its_parts(spark, with_other):
    rows = split_rows(random.Random(11), with_other)
    df = spark.createDataFrame(rows, "split string, question string, pg_sql string, label string")
    overlap = splits.overlaps(df, ["question", "pg_sql"], (*corpus.SPLITS, "other"))
    parts = splits.split_gate(overlap, splits.drift(splits.class_counts(df)))
    assert sorted(map(tuple, corpus.gate(df).collect())) == sorted(map(tuple, parts.collect()))


def test_gate_of_nothing_passes(spark):
    df = spark.createDataFrame([], "split string, question string, pg_sql string, label string")
    assert {r.check_name: (r.passed, r.message) for r in corpus.gate(df).collect()} == {
        "val_test_overlap": (True, "0 shared"), "train_val_overlap": (True, "0 shared (warning)"),
        "train_test_overlap": (True, "0 shared (warning)"), "distribution": (True, "0.0 points"),
    }


def test_gate_reads_its_rows_once(spark, tmp_path):
    rows = split_rows(random.Random(2), True)
    spark.createDataFrame(rows, "split string, question string, pg_sql string, label string").write.parquet(str(tmp_path / "in"))
    plan = corpus.gate(spark.read.parquet(str(tmp_path / "in")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
