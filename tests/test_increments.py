"""Sketches of batches against exact sets."""

import random

import pytest

from sqlcorpus.operators import increments as inc

SPLITS = ("train", "validation", "test")
KEYS = {"text": ["question", "sql"], "db": ["db_id"]}
SCHEMA = "split string, question string, sql string, db_id string"


def batches(seed, size, keys):
    rng = random.Random(seed)
    def row():
        return (rng.choice(SPLITS), f"q{rng.randrange(keys)}", rng.choice(["s", "", None]), rng.choice([f"d{i}" for i in range(40)] + [None]))
    return [[row() for _ in range(size)] for _ in range(3)]


def sets(rows, key):
    out = {s: set() for s in SPLITS}
    for r in rows:
        if any(v is not None for v in key(r)):
            out[r[0]].add(key(r))
    return out


def store(spark, tmp_path, parts, entries=inc.LG_ENTRIES):
    path = str(tmp_path / "sketches")
    for number, rows in enumerate(parts):
        sketches = inc.batch_sketches(spark.createDataFrame(rows, SCHEMA), KEYS, entries)
        sketches.write.parquet(f"{path}/batch={number}")
    return path


def test_merged_sketches_equal_sets(spark, tmp_path):
    parts = batches(1, 300, 500)
    path = store(spark, tmp_path, parts)
    rows = [r for p in parts for r in p]
    counts = {(r["split"], r["name"]): r["n"] for r in inc.merged(spark, path).collect()}
    for name, key in (("text", lambda r: r[1:3]), ("db", lambda r: r[3:])):
        expected = sets(rows, key)
        assert {s: counts[s, name] for s in SPLITS} == {s: len(v) for s, v in expected.items()}
    found = inc.overlaps(spark, path, "text", ["question", "sql"], SPLITS, lambda: spark.createDataFrame(rows, SCHEMA)).collect()
    expected = sets(rows, lambda r: r[1:3])
    assert len(found) == 3
    for r in found:
        shared = len(expected[r["first"]] & expected[r["second"]])
        assert r["estimate"] == r["upper"] == r["exact"] == shared > 0


def test_a_second_batch_reads_only_sketches_of_the_first(spark, tmp_path):
    first = [("train", f"q{i}", "s", "d") for i in range(200)]
    second = [("test", f"r{i}", "s", "d") for i in range(200)]
    path = store(spark, tmp_path, [first, second])

    def rows_needed():
        raise AssertionError("rows of the batches were read")

    found = inc.overlaps(spark, path, "text", ["question", "sql"], SPLITS, rows_needed).collect()
    assert [(r["upper"], r["exact"]) for r in found] == [(0, None)] * 3


@pytest.mark.parametrize("seed", range(4))
def test_bound_holds_beyond_the_entries(spark, tmp_path, seed):
    parts = batches(seed, 4000, 6000)
    path = store(spark, tmp_path, parts, 8)
    rows = [r for p in parts for r in p]
    df = spark.createDataFrame(rows, SCHEMA)
    found = inc.overlaps(spark, path, "text", ["question", "sql"], SPLITS, lambda: df, lg_entries=8).collect()
    expected = sets(rows, lambda r: r[1:3])
    for r in found:
        shared = len(expected[r["first"]] & expected[r["second"]])
        assert r["exact"] == shared and r["upper"] >= shared and abs(r["estimate"] - shared) < shared / 2


def test_one_shared_key_is_found_by_the_exact_count(spark, tmp_path):
    """A sketch may miss a single key; its bound does not claim there is none."""
    rows = [("train", f"q{i}", "s", "d") for i in range(5000)] + [("test", f"r{i}", "s", "d") for i in range(5000)] + [("test", "q7", "s", "d")]
    path = store(spark, tmp_path, [rows], 6)
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r["first"], r["second"]): r["exact"] for r in inc.overlaps(spark, path, "text", ["question", "sql"], SPLITS, lambda: df, lg_entries=6).collect()}
    assert found["train", "test"] == 1


def test_adding_a_batch_again_replaces_it(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([("train", "q", "s", "d")], SCHEMA)
    for _ in range(2):
        inc.add_batch(rows, 1, KEYS, path)
    inc.add_batch(rows.limit(0), 2, KEYS, path)
    assert {r["name"]: r["n"] for r in inc.merged(spark, path).collect()} == {"text": 1, "db": 1}
