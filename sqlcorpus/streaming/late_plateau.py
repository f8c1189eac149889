"""Early stopping on a live stream whose evaluations arrive late and out of order.

Evaluations wait in the state of their run until the watermark has passed them; then nothing earlier can
still come, and they are walked in step order. The verdicts are those of the batch form.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sqlcorpus import fixed_values as fv
from sqlcorpus.session import scratch_path
from sqlcorpus.streaming.plateau import OUTPUT, STATE

#: Evaluations wait in chunks of at most so many; an entry of the state for each one would cost a call to the JVM.
CHUNK = 10_000
ENTRY = np.dtype([("step", "<i8"), ("at", "<i8"), ("loss", "<f8")])


def improves(loss: float, best: float | None, min_delta: float) -> bool:
    """A first value always improves; a NaN never does, and nothing improves on a first NaN."""
    return best is None or loss < best - min_delta


class PlateauProcessor(StatefulProcessor):
    """Per run: the walk so far, the evaluations the watermark has not passed, and the time of the last one.

    The evaluations lie in numbered chunks, each sorted by step; ``firsts`` has the first step of each, so that
    a walk loads a chunk when it comes to it. Chunks are numbered in order of arrival.
    """

    def __init__(self, patience: int, min_delta: float, forget_after_ms: int | None):
        self.patience, self.min_delta, self.forget_after_ms = patience, min_delta, forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.walked = handle.getValueState("walked", STATE)
        self.pending = handle.getMapState("pending", "chunk long", "entries binary")
        self.firsts = handle.getMapState("firsts", "chunk long", "step long")
        self.latest = handle.getValueState("latest", "at long, chunks long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stopped = self.walked.exists() and self.walked.get()[2]
        latest, chunks = self.latest.get() if self.latest.exists() else (None, 0)
        earliest = None
        entries = ((row["step"], row["at"], row["loss"]) for row in rows)
        while chunk := list(islice(entries, CHUNK)):
            last = max(at for _, at, _ in chunk)
            latest = last if latest is None else max(latest, last)
            if not stopped:
                self._put(chunks, np.array(chunk, ENTRY))
                chunks += 1
                first = min(at for _, at, _ in chunk)
                earliest = first if earliest is None else min(earliest, first)
        if latest is not None:
            self.latest.update((latest, chunks))
        if earliest is not None:
            self.handle.registerTimer(earliest)
        if self.forget_after_ms is not None and latest is not None:
            self.handle.registerTimer(latest + self.forget_after_ms)
        return iter(())

    def _put(self, number: int, chunk: np.ndarray) -> None:
        chunk = chunk[np.argsort(chunk["step"], kind="stable")]
        self.pending.updateValue((number,), (chunk.tobytes(),))
        self.firsts.updateValue((number,), (int(chunk["step"][0]),))

    def _get(self, number: int) -> np.ndarray:
        return np.frombuffer(bytes(self.pending.getValue((number,))[0]), ENTRY)

    def _in_order(self, firsts: dict[int, int]) -> Iterator[tuple[int, int, float]]:
        """Waiting ``(step, at, loss)`` by step, repeats of a step in order of arrival."""
        waiting = deque(sorted((step, number) for number, step in firsts.items()))
        active: list[tuple] = []
        while waiting or active:
            while waiting and (not active or waiting[0][0] <= active[0][0]):
                step, number = waiting.popleft()
                heappush(active, (step, number, 0, self._get(number)))
            _, number, place, chunk = active[0]
            yield chunk[place].item()
            if place + 1 < len(chunk):
                heapreplace(active, (int(chunk["step"][place + 1]), number, place + 1, chunk))
            else:
                heappop(active)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        best, wait, stopped = self.walked.get() if self.walked.exists() else (None, 0, False)
        firsts = {number[0]: step[0] for number, step in self.firsts.iterator()}
        out, repeated = [], []
        for step, repeats in groupby(() if stopped else self._in_order(firsts), itemgetter(0)):
            *before, (_, at, loss) = repeats
            if at > passed:
                continue
            if before:
                repeated.append(step)
            if improves(loss, best, self.min_delta):
                best, wait = loss, 0
            else:
                wait += 1
                stopped = wait >= self.patience
            out.append(Row(run_id=key[0], step=step, best_loss=best, wait_count=wait, should_stop=stopped))
            if stopped:
                break
        later = None
        if stopped:
            self.pending.clear()
            self.firsts.clear()
        else:
            later = self._drop_passed(firsts, passed, repeated)
            if later is not None:
                self.handle.registerTimer(later)
        if best is not None:
            self.walked.update((best, wait, stopped))
        self._forget(passed, later is not None)
        return iter(out)

    def _drop_passed(self, firsts: dict[int, int], passed: int, repeated: list[int]) -> int | None:
        """Keep what the watermark has not passed; the time of the earliest of it."""
        later = None
        for number in firsts:
            chunk = self._get(number)
            kept = chunk[(chunk["at"] > passed) & ~np.isin(chunk["step"], repeated)]
            if not len(kept):
                self.pending.removeKey((number,))
                self.firsts.removeKey((number,))
                continue
            first = int(kept["at"].min())
            later = first if later is None else min(later, first)
            if len(kept) < len(chunk):
                self._put(number, kept)
        return later

    def _forget(self, passed: int, waiting: bool) -> None:
        """Drop a run whose last evaluation is older than the stated time."""
        if self.forget_after_ms is None or waiting or not self.latest.exists():
            return
        if self.latest.get()[0] + self.forget_after_ms <= passed:
            self.walked.clear()
            self.pending.clear()
            self.firsts.clear()
            self.latest.clear()


def watch_late_plateau(
    evaluations: DataFrame,
    lateness: str = "10 minutes",
    patience: int = fv.PATIENCE,
    min_delta: float = fv.MIN_DELTA,
    forget_after_ms: int | None = None,
) -> DataFrame:
    """Stream ``(run_id, step, ts, loss)`` to one verdict per evaluation, until the run is told to stop.

    Evaluations may arrive in any order within ``lateness`` of event time; ``ts`` rises with ``step`` in a run, and
    steps are unique (of repeats the last to arrive counts). A verdict comes once the watermark has passed its
    evaluation. Nulls are ignored, and NaN is treated as in the batch form. State per run: three values and the
    evaluations of the last ``lateness``; ``forget_after_ms`` drops a run that long after its last evaluation, and a run
    that comes back later starts anew. Needs the RocksDB state store (``use_rocksdb``).
    """
    timed = evaluations.withWatermark("ts", lateness).where(F.col("loss").isNotNull())
    points = timed.select("run_id", "step", "ts", F.unix_millis(F.col("ts")).alias("at"), "loss")
    return points.groupBy("run_id").transformWithState(
        PlateauProcessor(patience, min_delta, forget_after_ms), OUTPUT, "Append", "EventTime"
    )


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> str | None:
    """Keep streaming state in RocksDB, as state with timers needs; the provider set before."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return before


def replay(spark: SparkSession, batches: list[DataFrame], **options) -> DataFrame:
    """Verdicts of stored ``(run_id, step, ts, loss)`` batches, streamed one after the other through ``watch_late_plateau``.

    The batches, the stream's checkpoint and its verdicts lie in the shared scratch folder. A last batch, one
    evaluation of run null a year after all others, moves the watermark past them.
    """
    root = scratch_path(spark, "replay")
    columns = ["run_id", "step", "ts", "loss"]
    end = None
    for number, batch in enumerate(batches):
        batch.select(*columns).coalesce(1).write.parquet(f"{root}/in/{number:04d}")
        last = spark.read.parquet(f"{root}/in/{number:04d}").agg(F.max("ts").alias("ts")).first()["ts"]
        end = last if end is None or (last is not None and last > end) else end
    schema = batches[0].select(*columns).schema
    if end is not None:
        ahead = spark.range(1).select(
            F.lit(None).alias("run_id"), F.lit(0).alias("step"), (F.lit(end) + F.expr("INTERVAL 365 DAYS")).alias("ts"), F.lit(0.0).alias("loss"))
        typed = ahead.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        typed.write.parquet(f"{root}/in/{len(batches):04d}")
    before = use_rocksdb(spark)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in/*")
        verdicts = watch_late_plateau(stream, **options)
        writer = verdicts.writeStream.format("parquet").outputMode("append").option("path", f"{root}/verdicts")
        writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(verdicts.schema).parquet(f"{root}/verdicts")
