"""Early stopping on a live stream of evaluations, one small state per run."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sqlcorpus import fixed_values as fv

OUTPUT = "run_id long, step long, best_loss double, wait_count int, should_stop boolean"
STATE = "best double, wait int, stopped boolean"


def watch_plateau(
    evaluations: DataFrame, patience: int = fv.PATIENCE, min_delta: float = fv.MIN_DELTA
) -> DataFrame:
    """Stream ``(run_id, step, loss)`` to one verdict per evaluation, until the run is told to stop.

    The state is three values per run, however long the run is. Evaluations of a run must arrive in
    step order across micro-batches; inside a batch they are sorted here. As in the batch form, nulls are
    ignored, a NaN never improves, and nothing improves on a first NaN.
    """
    # pandas cannot tell nulls from NaN, so nulls leave before
    present = evaluations.where(evaluations["loss"].isNotNull())

    def walk(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, wait, stopped = state.get if state.exists else (None, 0, False)
        arrived = pd.concat(list(batches), ignore_index=True).sort_values("step")
        out = []
        for step, loss in zip(arrived["step"], arrived["loss"]):
            if stopped:
                break
            if best is None or loss < best - min_delta:
                best, wait = float(loss), 0
            else:
                wait += 1
                stopped = wait >= patience
            out.append((key[0], int(step), best, wait, stopped))
        state.update((best, wait, stopped))
        yield pd.DataFrame(out, columns=["run_id", "step", "best_loss", "wait_count", "should_stop"])

    return present.groupBy("run_id").applyInPandasWithState(
        walk, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )
