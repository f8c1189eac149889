"""Split, leak and drift invariants; distributions against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sqlcorpus.operators import splits, stats
from sqlcorpus.plans import corpus


def brute_force_split(rows, ratio, seed=42):
    groups = defaultdict(list)
    for key, stratum in rows:
        groups[stratum].append((hashlib.md5(f"{seed}|{key}".encode()).hexdigest(), key))
    first = set()
    for members in groups.values():
        members.sort()
        first |= {key for _, key in members[: int(len(members) * ratio)]}
    return first


@pytest.mark.parametrize("ratio", [0.0, 0.1, 0.5, 0.75, 1.0])
@pytest.mark.parametrize("digits", [1, 3])
def test_split_equals_brute_force(spark, ratio, digits):
    rng = random.Random(7)
    # one stratum holds most rows, one has a single row, one is null
    rows = [(i, rng.choice(["a"] * 8 + ["b", "c", None])) for i in range(700)] + [(700, "lonely")]
    df = spark.createDataFrame(rows, "id long, label string")
    out = splits.stratified_split(df, "label", ratio=ratio, digits=digits, names=("A", "B")).collect()
    assert len(out) == len(rows)
    assert {r.id for r in out if r.split == "A"} == brute_force_split(rows, ratio)


def test_split_without_broadcast(spark):
    rows = [(i, f"s{i % 5}") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label string")
    bound = splits.MAX_BROADCAST_STRATA + 1
    out = splits.stratified_split(df, "label", strata_bound=bound, names=("A", "B")).collect()
    assert {r.id for r in out if r.split == "A"} == brute_force_split(rows, 0.5) and len(out) == 300


def test_split_ignores_partitioning(spark):
    df = spark.range(200).withColumn("label", F.lit("x"))
    one = {r.id for r in splits.stratified_split(df.coalesce(1), "label").where("split = 'test'").collect()}
    many = {r.id for r in splits.stratified_split(df.repartition(9), "label").where("split = 'test'").collect()}
    assert one == many and len(one) == 100


def test_mixed_classes_stay_balanced(spark):
    sqls = ["SELECT * FROM t;"] * 40 + ["SELECT * FROM a JOIN b ON a.id = b.a_id;"] * 30 + ["SELECT * FROM a WHERE id IN (SELECT id FROM b);"] * 30
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sqls)], "id long, pg_sql string")
    out = splits.stratified_split(corpus.classified(rows), "label", strata_bound=5)
    counts = {r.split: r.n for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert counts == {"validation": 50, "test": 50}
    assert splits.drift(splits.class_counts(out)).first()[0] == 0


def test_overlaps_count_distinct_pairs(spark):
    rows = [("train", "q", "s")] * 500 + [("validation", "q", "s")] * 3 + [("test", "q", "t"), ("validation", "q", "t"), ("test", "z", "s")]
    df = spark.createDataFrame(rows, "split string, question string, sql string")
    row = splits.overlaps(df, ["question", "sql"], corpus.SPLITS).first()
    assert tuple(row) == (1, 0, 1)
    gate = splits.split_gate(splits.overlaps(df, ["question", "sql"], corpus.SPLITS), spark.createDataFrame([(5.1,)], "max_diff double"))
    verdict = {r.check_name: r.passed for r in gate.collect()}
    assert verdict == {"val_test_overlap": False, "train_val_overlap": True, "train_test_overlap": True, "distribution": False}
    assert splits.is_valid(gate).first().valid is False


def test_drift_counts_absent_labels_as_zero(spark):
    rows = [("validation", "a", 9), ("validation", "b", 1), ("test", "a", 10), ("train", "c", 5)]
    df = spark.createDataFrame(rows, "split string, label string, n long")
    assert round(splits.drift(df).first()[0], 9) == 10.0
    assert splits.drift(df.where("split = 'train'")).first()[0] == 0
    assert splits.drift(df.where("split = 'validation'")).first()[0] == 90.0


@pytest.mark.parametrize("values", [[5], [1, 2], [3, 1, 2], [4, 1, 3, 2], [7] * 10 + [1], list(range(101))])
def test_distribution_equals_sorted_list(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "split string, v long")
    row = stats.distribution(df, "split", ["v"]).first()
    ordered = sorted(values)
    assert (row.n, row.min, row.max, row.median) == (len(values), ordered[0], ordered[-1], ordered[len(values) // 2])
    assert abs(row.avg - sum(values) / len(values)) <= 0.05


def test_weighted_distribution_equals_repeated_rows(spark):
    rng = random.Random(3)
    weighted = [("g", rng.randint(0, 9), rng.randint(1, 5)) for _ in range(40)]
    repeated = [("g", v) for _, v, w in weighted for _ in range(w)]
    a = stats.distribution(spark.createDataFrame(weighted, "split string, v long, w long"), "split", ["v"], weight="w")
    b = stats.distribution(spark.createDataFrame(repeated, "split string, v long"), "split", ["v"])
    assert a.collect() == b.collect()


def test_empty_split_reports_zeros(spark):
    groups = spark.createDataFrame([("train",), ("test",)], "split string")
    data = spark.createDataFrame([("train", 3)], "split string, v long")
    rows = {r.split: r for r in stats.zero_filled(stats.distribution(data, "split", ["v"]), groups, "split", ["v"]).collect()}
    assert (rows["test"].max, rows["test"].median, rows["train"].max) == (0, 0, 3)


def test_totals_and_databases(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", None)], "split string, db_id string")
    assert {r.split: r.n for r in stats.example_totals(df).collect()} == {"a": 2, "b": 2, None: 4}
    exact = {r.split: r.n_databases for r in stats.distinct_databases(df).collect()}
    assert exact == {"a": 2, "b": 1}
    assert {r.split: r.n_databases for r in stats.distinct_databases(df, approximate=True).collect()} == exact


def test_class_counts_sum_to_total(spark):
    sqls = ["SELECT 1", "SELECT a FROM b JOIN c", "SELECT 1 FROM (SELECT 2)", "SELECT MAX(a) FROM (SELECT 2)"]
    df = spark.createDataFrame([("train", s) for s in sqls * 3], "split string, sql string")
    rows = stats.report_classes(df).collect()
    assert sum(r.n for r in rows) == 12 and {r.pct for r in rows} == {25.0}
    assert {r.feature for r in stats.feature_counts(df).collect()} == {"has_select", "has_join", "has_subquery", "has_max", "has_aggregation"}


def test_token_dictionary_and_tensors(spark):
    from collections import Counter

    from sqlcorpus.operators import model_input

    texts = {i: " ".join(f"w{(i * j) % 11}" for j in range(i)) for i in range(30)} | {30: None, 31: ""}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    counts = Counter(w for t in texts.values() for w in (t or "").split())
    want = {w: i + 1 for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0])))}
    dictionary = model_input.token_dictionary(df)
    assert {r.token: r.token_id for r in dictionary.collect()} == want
    got = {r.id: r for r in model_input.model_tensors(df, dictionary, "id", max_length=9).collect()}
    for i, t in texts.items():
        ids = [want[w] for w in (t or "").split()][:9]
        pad = [0] * (9 - len(ids))
        assert (got[i].input_ids, got[i].attention_mask, got[i].labels) == (ids + pad, [1] * len(ids) + pad, ids + pad)


def test_an_empty_split_has_zeros(spark):
    from sqlcorpus.operators import stats

    rows = spark.createDataFrame([("train", m, 2, 1, 3, 2.0, 3) for m in stats.TEXT_METRICS], "split string, metric string, n long, min long, max long, avg double, median long")
    got = {(r.split, r.metric): tuple(r)[2:] for r in stats.with_expected(rows, "split", ("train", "test")).collect()}
    assert got == {(s, m): (2, 1, 3, 2.0, 3) if s == "train" else (0, 0, 0, 0.0, 0) for s in ("train", "test") for m in stats.TEXT_METRICS}
