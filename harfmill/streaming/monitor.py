"""Extensions for unbounded input: windowed losses and an early-stop monitor keyed by run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_loss(events: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Mean loss per run and window; rows later than the watermark are dropped by design.  events: run, ts, loss."""
    return events.withWatermark("ts", lateness).groupBy("run", F.window("ts", width).alias("w")).agg(F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).alias("n")).select("run", "w.start", "w.end", "mean_loss", "n")


def stop_monitor(events: DataFrame, patience: int = 3, delta: float = 0.0) -> DataFrame:
    """A row for each run whenever its best loss or its verdict changes.  events: run, step, loss; steps of a run come in order of arrival."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, bad, stopped = state.get if state.exists else (float("inf"), 0, -1)
        before = (best, stopped)
        for part in parts:
            for step, loss in part.sort_values("step")[["step", "loss"]].itertuples(index=False):
                if stopped < 0:
                    if loss + delta < best:
                        best, bad = float(loss), 0
                    else:
                        bad += 1
                        if bad >= patience:
                            stopped = int(step)
        state.update((best, bad, stopped))
        if (best, stopped) != before:
            yield pd.DataFrame({"run": [key[0]], "best": [best], "stopped": [stopped]})

    return events.groupBy("run").applyInPandasWithState(update, "run long, best double, stopped long", "best double, bad long, stopped long", "update", GroupStateTimeout.NoTimeout)
