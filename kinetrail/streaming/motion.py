"""The sequence operators on streams: windowed motion statistics and a running longest run per trajectory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_stats(stream: DataFrame, by: list[str], time: str, value: str, size: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count, mean, std (ddof 0) and range of each trajectory in time windows; rows later than ``late`` are dropped.

    ``time`` may lack a zone: watermarks need a timestamp with one, so it's cast.
    """
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    found = rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.max(value) - F.min(value)).alias("range"))
    return found.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "std", "range")


def sessions(stream: DataFrame, by: list[str], time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Activity sessions: rows of a trajectory less than ``gap`` apart."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    found = rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return found.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_longest_run(stream: DataFrame, by: str, order: str, flag: str) -> DataFrame:
    """(by, n, longest) after each batch: the longest run of true flags so far, whatever the batches' bounds.

    State is four numbers a trajectory. Within a batch rows are put in ``order``; across batches they must not go back.
    """
    kind = stream.schema[by].dataType.simpleString()

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, now, best = state.get if state.exists else (0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(order)
        for on in rows[flag].fillna(False):
            now = now + 1 if on else 0
            best = max(best, now)
        n += len(rows)
        state.update((n, now, best))
        yield pd.DataFrame([(key[0], n, best)], columns=[by, "n", "longest"])

    return stream.groupBy(by).applyInPandasWithState(update, f"{by} {kind}, n long, longest long", "n long, now long, best long", "update", GroupStateTimeout.NoTimeout)
