"""Early stopping on late and shuffled evaluations gives the verdicts of the batch form."""

import random
from datetime import datetime, timedelta

import pytest

from sqlcorpus.operators import trainlog
from sqlcorpus.streaming.late_plateau import PlateauProcessor, use_rocksdb, watch_late_plateau

SCHEMA = "run_id long, step long, ts timestamp, loss double"
START = datetime(2026, 1, 1)
NAN = float("nan")


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    use_rocksdb(spark)
    yield
    spark.conf.set(name, before)


def watch(spark, tmp_path, batches, name, **options):
    """Run the stream over one file per batch, in order, and give its verdicts."""
    for number, rows in enumerate(batches):
        part = tmp_path / f"part{number}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(part))
        (tmp_path / "in").mkdir(exist_ok=True)
        data = next(part.glob("*.parquet"))
        data.rename(tmp_path / "in" / f"{number:03d}.parquet")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = (
        watch_late_plateau(stream, **options).writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(180)
    return spark.sql(f"SELECT * FROM {name}").collect()


def evaluation(run, step, loss):
    return (run, step, START + timedelta(minutes=step), loss)


def test_late_and_nan_evaluations_equal_the_batch(spark, rocksdb, tmp_path):
    rng = random.Random(3)
    rows = []
    for run in range(8):
        value = 5.0
        for step in range(30):
            value -= rng.choice([0.0, 0.0, 0.2, -0.1])
            loss = rng.choice([value] * 8 + [NAN, None])
            rows.append(evaluation(run, step, loss))
    rows += [evaluation(8, step, loss) for step, loss in enumerate([NAN, 1.0, 0.5, 0.2, 0.1])]
    # displaced by up to 8 minutes, so every batch holds evaluations older than those of the one before
    arrival = sorted(rows, key=lambda row: row[1] + rng.uniform(0, 8))
    size = len(arrival) // 5
    batches = [arrival[i : i + size] for i in range(0, len(arrival), size)]
    # a run far ahead moves the watermark past all others
    batches.append([(99, 0, START + timedelta(days=1), 1.0)])
    batches.append([(99, 1, START + timedelta(days=2), 0.5)])
    verdicts = watch(spark, tmp_path, batches, "late", lateness="10 minutes")
    stops = {v.run_id: v.step for v in verdicts if v.should_stop}
    log = spark.createDataFrame(rows, SCHEMA)
    expected = {r.run_id: r.stop_step for r in trainlog.plateau(log).collect() if r.stop_step is not None}
    assert stops == expected and stops
    assert not [v for v in verdicts if v.run_id in stops and v.step > stops[v.run_id]]


def test_nothing_is_walked_before_the_watermark_passes(spark, rocksdb, tmp_path):
    verdicts = watch(spark, tmp_path, [[evaluation(1, step, 1.0) for step in range(8)]], "early", lateness="1 hour")
    assert verdicts == []


def test_an_idle_run_is_forgotten(spark, rocksdb, tmp_path):
    far = START + timedelta(days=1)
    batches = [
        [evaluation(1, step, 1.0) for step in range(5)],
        [(2, 0, far, 1.0)],
        [(2, 1, far + timedelta(days=1), 1.0)],
        [(1, 100, far + timedelta(days=2), 9.0)],
        [(2, 2, far + timedelta(days=4), 1.0)],
        [(2, 3, far + timedelta(days=6), 1.0)],
    ]
    verdicts = watch(spark, tmp_path, batches, "idle", lateness="1 minute", forget_after_ms=3_600_000)
    back = [v for v in verdicts if v.run_id == 1 and v.step == 100]
    assert [(v.best_loss, v.wait_count) for v in back] == [(9.0, 0)]


class Held:
    """State of one run in plain Python, counting the writes."""

    def __init__(self):
        self.value, self.map, self.writes, self.timers = None, {}, 0, []

    getValueState = getMapState = lambda self, name, *schema: self.__dict__.setdefault(name, Held())
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    getValue = lambda self, key: self.map[key]
    iterator = lambda self: iter(list(self.map.items()))
    removeKey = lambda self, key: self.map.pop(key)
    registerTimer = lambda self, at: self.timers.append(at)

    def update(self, value):
        self.value = value

    def updateValue(self, key, value):
        self.map[key], self.writes = value, self.writes + 1

    def clear(self):
        self.value = None
        self.map.clear()


class At:
    def __init__(self, at):
        self.getCurrentWatermarkInMs = lambda: at


def test_evaluations_of_a_run_wait_in_few_chunks():
    from pyspark.sql import Row

    held, processor = Held(), PlateauProcessor(3, 0.01, None)
    processor.init(held)
    steps = list(range(25_000))
    random.Random(4).shuffle(steps)
    # a repeat of a step: the last to arrive counts, and nothing of it is left
    rows = [Row(step=9, at=30_000, loss=0.0), *(Row(step=s, at=s, loss=100_000.0 - s) for s in steps)]
    list(processor.handleInputRows((1,), iter(rows), None))
    assert held.pending.writes <= 3 and held.timers == [0]
    first = list(processor.handleExpiredTimer((1,), At(11_999), None))
    assert [v.step for v in first] == list(range(12_000)) and not any(v.should_stop for v in first)
    assert held.timers[-1] == 12_000
    rest = list(processor.handleExpiredTimer((1,), At(40_000), None))
    assert [v.step for v in rest] == list(range(12_000, 25_000)) and not held.pending.map
