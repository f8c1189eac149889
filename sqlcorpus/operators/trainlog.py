"""Training-log analytics: progress with time left, and plateau detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlcorpus import fixed_values as fv
from sqlcorpus.operators.skew import join_wide

STEPS_PER_CHUNK = 10_000


def _seconds(interval: Column) -> Column:
    """Length of a day-time interval in seconds; works without any session time zone."""

    def part(field: str) -> Column:
        return F.extract(F.lit(field), interval).cast("double")

    return part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")


def run_facts(log: DataFrame) -> DataFrame:
    """Start time and last step per run, by partial aggregation."""
    return log.groupBy("run_id").agg(F.min("ts").alias("started"), F.max("step").alias("total_steps"))


def progress(log: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Per log row: share done, seconds elapsed and seconds left (null while nothing is done).

    ``runs(run_id, started, total_steps)`` gives planned totals; by default they come from the log.
    One row per run is joined back, by broadcast when small and with salted hot runs otherwise.
    """
    facts = run_facts(log) if runs is None else runs
    joined = join_wide(log, facts, "run_id", "step", [])
    elapsed = _seconds(F.col("ts") - F.col("started"))
    done = F.when(F.col("total_steps") > 0, F.col("step") / F.col("total_steps"))
    return joined.select(
        *log.columns,
        F.round(F.coalesce(done, F.lit(0.0)) * 100, 1).alias("progress_pct"),
        F.round(elapsed, 3).alias("elapsed_s"),
        F.round(F.when(done > 0, elapsed / done - elapsed), 3).alias("remaining_s"),
    )


def _fold(series: Column, patience: int, min_delta: float) -> Column:
    """Walk a sorted ``array<struct<step, value>>``; the state freezes once the plateau fires."""
    start = F.struct(
        F.lit(None).cast("double").alias("best"),
        F.lit(0).alias("wait"),
        F.lit(None).cast("long").alias("stop_step"),
    )

    def step(state: Column, point: Column) -> Column:
        value = point["value"]
        better = ~F.isnan(state["best"]) & (value < state["best"] - F.lit(min_delta))
        waited = state["wait"] + 1

        def new(best: Column, wait: Column, stop: Column) -> Column:
            return F.struct(best.alias("best"), wait.alias("wait"), stop.alias("stop_step"))

        none = F.lit(None).cast("long")
        return (
            F.when(state["stop_step"].isNotNull(), state)
            .when(state["best"].isNull(), new(value, F.lit(0), none))
            .when(better, new(value, F.lit(0), none))
            .otherwise(new(state["best"], waited, F.when(waited >= patience, point["step"])))
        )

    return F.aggregate(series, start, step)


def _entries(series: Column, patience: int, min_delta: float) -> Column:
    """What a chunk does to any state that comes in, in at most ``patience`` entries.

    Within ``patience`` evaluations a run improves or stops, so its first improvement in a chunk is one of the
    chunk's first ``patience`` evaluations, and what follows depends on that evaluation alone: ``then`` is the walk
    that begins there.
    """

    def entry(point: Column, at: Column) -> Column:
        rest = F.slice(series, at + 1, F.size(series))
        return F.struct(at.alias("at"), point["step"].alias("step"), point["value"].alias("value"), _fold(rest, patience, min_delta).alias("then"))

    return F.transform(F.slice(series, 1, patience), entry)


def _compose(chunks: Column, patience: int, min_delta: float) -> Column:
    """The state after the ordered ``array<struct<chunk, entries>>`` of a run."""
    start = F.struct(
        F.lit(None).cast("double").alias("best"), F.lit(0).alias("wait"), F.lit(None).cast("long").alias("stop_step"))

    def through(state: Column, chunk: Column) -> Column:
        best, left, entries = state["best"], F.lit(patience) - state["wait"], chunk["entries"]
        better = F.filter(entries, lambda e: best.isNull() | (~F.isnan(best) & (e["value"] < best - F.lit(min_delta))))
        first, fatal = F.get(better, F.lit(0)), F.get(entries, left - 1)

        def waited(wait: Column, stop: Column) -> Column:
            return F.struct(best.alias("best"), wait.alias("wait"), stop.alias("stop_step"))

        return (
            F.when(state["stop_step"].isNotNull(), state)
            .when(first.isNotNull() & (first["at"] < left), first["then"])
            .when(fatal.isNotNull(), waited(F.lit(patience), fatal["step"]))
            .otherwise(waited(state["wait"] + F.size(entries), F.lit(None).cast("long")))
        )

    return F.aggregate(chunks, start, through)


def evaluations_needed(first: Column, lowest: Column, count: Column, patience: int, min_delta: float) -> Column:
    """How many leading evaluations decide a run.

    Until the plateau fires, at least one of any ``patience`` evaluations in a row lowers the best
    value by more than ``min_delta``. That can happen ``(first - lowest) / min_delta`` times at most,
    so a run with more evaluations than this bound has fired within it.
    """
    falls = F.least((first - lowest) / F.lit(min_delta), count.cast("double"))
    falls = F.when(F.isnan(first) | F.isnan(lowest), count.cast("double")).otherwise(falls)
    return (F.floor(falls) + 2) * F.lit(patience) + 1


def plateau(
    log: DataFrame, value_col: str = "loss", patience: int = fv.PATIENCE, min_delta: float = fv.MIN_DELTA
) -> DataFrame:
    """Per run: the step at which training should stop (null when it never should), best and wait.

    Chunks of ``STEPS_PER_CHUNK`` steps are walked apart from each other, once for each way a run can enter
    them, and a run composes its chunks' ``patience`` outcomes: no task gathers more than one chunk's evaluations.
    Only a head of each run decides (``evaluations_needed``); chunks past it are filtered out before.
    Steps are unique within a run; null values are ignored.
    """
    if min_delta <= 0:
        raise ValueError("min_delta must be positive")
    value = F.col(value_col).cast("double")
    points = log.where(value.isNotNull()).select(
        "run_id", F.col("step").cast("long").alias("step"), value.alias("value"),
        F.floor(F.col("step") / STEPS_PER_CHUNK).alias("chunk"),
    )
    chunks = points.groupBy("run_id", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.min_by("value", "step").alias("head")
    )
    per_run = Window.partitionBy("run_id")
    ordered = per_run.orderBy("chunk")
    bounds = chunks.select(
        "run_id",
        "chunk",
        (F.sum("n").over(ordered) - F.col("n")).alias("before"),
        F.sum("n").over(per_run).alias("evaluations"),
        evaluations_needed(
            F.first("head").over(ordered), F.min("low").over(per_run), F.sum("n").over(per_run), patience, min_delta
        ).alias("needed"),
    )
    last_chunk = (
        bounds.where(F.col("before") < F.col("needed"))
        .groupBy("run_id")
        .agg(F.max("chunk").alias("last_chunk"), F.max("evaluations").alias("evaluations"))
    )
    heads = join_wide(points, last_chunk, "run_id", "step", []).where(F.col("chunk") <= F.col("last_chunk"))
    gathered = heads.groupBy("run_id", "chunk").agg(
        F.max("evaluations").alias("evaluations"), F.array_sort(F.collect_list(F.struct("step", "value"))).alias("series"))
    summed = gathered.select("run_id", "chunk", "evaluations", _entries(F.col("series"), patience, min_delta).alias("entries"))
    folded = summed.groupBy("run_id").agg(
        F.max("evaluations").alias("evaluations"),
        _compose(F.array_sort(F.collect_list(F.struct("chunk", "entries"))), patience, min_delta).alias("s"),
    )
    return folded.select(
        "run_id",
        "evaluations",
        F.col("s.stop_step").alias("stop_step"),
        F.col("s.best").alias("best_loss"),
        F.col("s.wait").alias("wait_count"),
    )
