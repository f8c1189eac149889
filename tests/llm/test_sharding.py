"""Shards: the law, slots, groups and a group that holds a third of all rows."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from sqlcorpus.llm import queries, sharding

SCHEMA = "doc_id bigint, text string, size string, shard int, slot int, k0 string, range string, _row string"


def checked(rows, got, shards):
    """Every row once with its size and checksum, slots gapless; returns bytes by shard."""
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots, total = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        total[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [total[s] for s in range(shards)]


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "s", 1, 2, "k", "r", "w") for r in rows], SCHEMA).repartition(parts)


def test_hot_group_is_subdivided_and_small_ones_stay_together(spark):
    random.seed(5)
    rows = [(i, "copy of one text") for i in range(3000)] + [(i, f"text {i} " * random.randint(1, 40)) for i in range(3000, 6000)]
    rows += [(7, "copy of one text")] * 400 + [(None, None)] * 300 + [(i, f"pair {i // 2}") for i in range(7000, 7400)]
    got = sharding.assign(frame(spark, rows)).collect()
    sizes = checked(rows, got, 24)
    assert max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 24
    shard = {r.doc_id: r.shard for r in got}
    # only a pair that a boundary of an overfull range fell on may be parted
    assert sum(shard[i] != shard[i + 1] for i in range(7000, 7400, 2)) == 0
    again = sharding.assign(frame(spark, rows)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


@pytest.mark.parametrize("shards,ranges,most", [(1, 1, 10), (3, 2, 5), (24, 64, 1_000_000)])
def test_odd_rows(spark, odd, shards, ranges, most):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sharding.assign(odd, shards=shards, ranges=ranges, range_rows=most).collect()
    checked(rows, got, shards)


def test_rows_bound_ranges(spark):
    rows = [(i % 50, "same") for i in range(1000)]
    records = sharding.stage(sharding.sized(frame(spark, rows)), "test-records")
    _, stats = sharding.choose(records, shards=2, ranges=1, range_rows=40)
    assert sum(n for _, n in stats.values()) == 1000 and max(n for _, n in stats.values()) <= 40


def test_hot_keys_are_isolated_in_few_rounds(spark):
    rows = [(i, f"hot {i % 3}") for i in range(6000)] + [(i, f"cold {i} {'x' * (i % 90)}") for i in range(6000, 9000)]
    records = sharding.stage(sharding.sized(frame(spark, rows)), "test-records")
    splitters, stats = sharding.choose(records)
    assert len(splitters.rounds) <= 6 and sum(n for _, n in stats.values()) == 9000


def test_deal_is_even():
    stats = {i: (random.Random(i).randint(1, 1000), i % 5 + 1) for i in range(2000)}
    dealt = sharding.deal(stats, 24)
    sizes, spans = Counter(), defaultdict(list)
    for i, (s, first) in dealt.items():
        sizes[s] += stats[i][0]
        spans[s].append((first, first + stats[i][1]))
    assert max(sizes.values()) - min(sizes.values()) <= 10  # about the smallest range
    for v in spans.values():
        v.sort()
        assert v[0][0] == 0 and all(a[1] == b[0] for a, b in zip(v, v[1:]))


def test_empty_and_query(spark, sf, empty):
    assert sharding.assign(empty).count() == 0
    df = queries.op13_sharding(spark, sf)
    assert [f"{n} {t}" for n, t in df.dtypes] == [
        "doc_id bigint", "size bigint", "text_crc32 bigint", "law string", "shard int", "slot bigint", "grown_shard int"]
    got = df.collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    sizes, largest = checked(rows, got, 24), max(r["size"] for r in got)
    assert max(sizes) - min(sizes) <= max(largest, sum(sizes) // 24) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_write_keeps_rows_and_columns(spark, odd, tmp_path):
    sharding.write(odd, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*odd.columns, "shard"}
    assert Counter(map(tuple, back.select(odd.columns).collect())) == Counter(map(tuple, odd.collect()))
