"""Signals of vector-valued frames: event signals over all channels of a group, and one scalar axis fitted over all trajectories.

Frames come long: trajectory keys, an order, a channel (``dim``) and its value. For event signals they are dealt out by
trajectory and sorted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.operators import models
from kinetrail.operators import timeseries as T

EVENT_COLUMNS = ["n_frames", "change_l1", "final_stability", "nan_ratio", "range_l1", "peak_offset_l1", "active_ratio", "stable_len", "stable_s"]
#: Rows of whole trajectories that a task looks at together.
BLOCK = 100_000


def _mean(at: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    """Means of ``n`` groups over the values that aren't missing, added up in order of rows; NaN for a group without any."""
    there = ~np.isnan(values)
    with np.errstate(invalid="ignore"):
        return np.bincount(at[there], values[there], n) / np.bincount(at[there], minlength=n)


def _quantile(at: np.ndarray, n: int, values: np.ndarray, p: float) -> np.ndarray:
    """Exact quantiles of ``n`` groups as :func:`columns.quantile` has them; NaN for a group without values."""
    there = ~np.isnan(values)
    at, values = at[there], values[there]
    values, count = np.append(values[np.lexsort((values, at))], np.nan), np.bincount(at, minlength=n)
    place, first = np.maximum(count - 1, 0) * p, np.cumsum(count) - count
    low, high = np.floor(place), np.ceil(place)
    a, b = (values[np.where(count > 0, first + x.astype(int), -1)] for x in (low, high))
    return np.where((low == high) | (a == b), a, (high - place) * a + (place - low) * b)


def _changes(columns: list[pa.ChunkedArray]) -> np.ndarray:
    """Which rows differ from the row before in any of the columns; NULLs are alike. The first row does."""
    new = np.arange(len(columns[0])) == 0
    for c in columns:
        a, b = c[1:], c[:-1]
        apart = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new[1:] |= apart.to_numpy()
    return new


def _channels(column: pa.ChunkedArray) -> np.ndarray:
    """Channels as numbers in their own order; -1 for NULL."""
    coded = column.combine_chunks().dictionary_encode()
    rank = np.empty(len(coded.dictionary) + 1, int)
    rank[-1], rank[pc.array_sort_indices(coded.dictionary).to_numpy()] = -1, np.arange(len(coded.dictionary))
    return rank[pc.fill_null(coded.indices, -1).to_numpy()]


def _event_figures(rows: pa.Table, by: list[str], moved_share: float, still: float, share: float, least: int) -> pa.Table:
    """:func:`vector_signals` of whole trajectories, whose rows come in order of trajectory and frame."""
    first = _changes([rows.column(c) for c in by])
    traj, frame = np.cumsum(first) - 1, np.cumsum(first | _changes([rows.column("k")])) - 1
    n_traj, n_frames, dims = traj[-1] + 1, frame[-1] + 1, _channels(rows.column("dim"))
    order = np.lexsort((dims, traj))  # stable: a channel's rows keep their order
    t, f, d, v = traj[order], frame[order], dims[order], rows.column("v").to_numpy()[order]

    new = np.append(True, (t[1:] != t[:-1]) | (d[1:] != d[:-1]))
    start, c = np.flatnonzero(new), np.cumsum(new) - 1
    n, of, count = np.diff(np.append(start, len(t))), t[start], len(start)
    i, m = np.arange(len(t)) - start[c], np.minimum(n, np.maximum(least, np.floor(n * share)))
    head, late = _mean(c, count, np.where(i < m[c], v, np.nan)), np.where(i >= (n - m)[c], v, np.nan)
    tail = _mean(c, count, late)
    spread, width = np.sqrt(_mean(c, count, (late - tail[c]) ** 2)), np.fmax.reduceat(v, start) - np.fmin.reduceat(v, start)
    middle = _quantile(c, count, np.where(np.isnan(head)[c], v, np.nan), 0.5)  # asked for only where there is no head
    values, named = np.bincount(c, ~np.isnan(v), count), d >= 0

    step = np.where(named & ~new, np.abs(v - np.append(np.nan, v[:-1])), np.nan)
    offset = _mean(f, n_frames, np.where(named, np.abs(v - np.where(np.isnan(head), middle, head)[c]), np.nan))
    step, opening = _mean(f, n_frames, step), np.bincount(f[named & (i == 0)], minlength=n_frames) > 0
    there = np.bincount(f[named], minlength=n_frames) > 0  # frames of a named channel
    at = traj[np.flatnonzero(np.append(True, frame[1:] != frame[:-1]))][there]
    offset, speed = offset[there], np.where(opening & ~np.isnan(offset), 0.0, step)[there]
    peak, calm = np.full(n_traj, np.nan), np.nan_to_num(_quantile(at, n_traj, speed, still))
    np.fmax.at(peak, at, offset)
    moved = (peak[at] > 1e-8) & (offset >= moved_share * peak[at])
    held = moved & (speed <= calm[at])
    island = np.cumsum(~held | np.append(True, at[1:] != at[:-1])[: len(at)]) - 1
    longest = np.zeros(n_traj, int)
    np.maximum.at(longest, at, np.bincount(island, held)[island].astype(int))
    most_frames = np.zeros(n_traj, int)
    np.maximum.at(most_frames, of, n)

    figures = {
        "n_frames": most_frames, "change_l1": _mean(of, n_traj, np.abs(tail - head)), "final_stability": _mean(of, n_traj, spread), "nan_ratio": 1 - np.bincount(of, values) / np.bincount(of, n),
        "range_l1": np.nan_to_num(_mean(of, n_traj, width)), "peak_offset_l1": np.where(peak > 1e-8, peak, 0.0), "active_ratio": np.nan_to_num(_mean(at, n_traj, np.where(np.isnan(offset), np.nan, moved))), "stable_len": longest,
    }
    told = rows.select(by).take(np.flatnonzero(first))
    for name, x in figures.items():
        told = told.append_column(name, pa.array(x, from_pandas=True))
    return told.filter(np.bincount(at, minlength=n_traj) > 0)


def vector_signals(df: DataFrame, by: list[str], order: str, dim: str, value: str, step_s: float = 0.01, moved_share: float = 0.6, still: float = 0.4, share: float = 0.1, least: int = 10) -> DataFrame:
    """One row a trajectory: ``EVENT_COLUMNS``.

    Head and tail are the first and last min(n, max(least, floor(share n))) frames. ``change_l1``: mean over channels of
    the tail's mean less the head's, absolute; ``final_stability``: mean of the tails' deviations (ddof 0); ``nan_ratio``:
    share of missing cells. A frame's offset is the mean distance of its channels from the heads' means (a channel
    without a value in the head starts at its median); its speed the mean step of its channels, 0 for the first frame.
    Moved: offset at least ``moved_share`` of the largest. Stable: speed at most the ``still`` quantile of all speeds.
    ``stable_len`` is the longest stretch of frames both moved and stable. Frames without any value are neither, and a
    step that has no value on one side is no step. Channels without any value don't count. A trajectory without values
    has 0 for the event signals and NULL for the others; one that never leaves its start keeps its range, the rest is 0.

    Rows are dealt out and sorted by trajectory once; a task then goes through them some whole trajectories at a time, so
    a single trajectory has to fit a worker's memory. Sums over channels go in order of ``dim``, whatever order rows came in.
    """
    rows = df.select(*by, F.col(order).alias("k"), F.col(dim).alias("dim"), F.col(value).cast("double").alias("v")).dropna(subset=by)
    rows = rows.repartition(*[F.col(c) for c in by]).sortWithinPartitions(*by, "k")
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by] + [f"{c} {'long' if c in ('n_frames', 'stable_len') else 'double'}" for c in EVENT_COLUMNS[:-1]]

    def run(batches: Iterator[pa.RecordBatch]):
        held: list[pa.RecordBatch] = []
        n, most = 0, BLOCK
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < most:
                continue
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_changes([table.column(c) for c in by]))[-1])
            if last:
                yield from _event_figures(table[:last], by, moved_share, still, share, least).to_batches()
            held, n = table[last:].to_batches(), table.num_rows - last
            most = max(BLOCK, 2 * n)  # a long trajectory is looked through again only when it has doubled
        if n:
            yield from _event_figures(pa.Table.from_batches(held), by, moved_share, still, share, least).to_batches()

    found = rows.mapInArrow(run, ", ".join(kinds))
    return found.withColumn("stable_s", F.col("stable_len") * F.lit(float(step_s))).select(*by, *EVENT_COLUMNS)


def frame_vectors(df: DataFrame, by: list[str], order: str, dim: str, value: str, into: str = "vector") -> DataFrame:
    """One row a frame: its channels' values in order of ``dim``, NULLs included."""
    cells = F.sort_array(F.collect_list(F.struct(F.col(dim).alias("d"), F.col(value).cast("double").alias("v"))))
    return df.groupBy(*by, order).agg(F.transform(cells, lambda c: c["v"]).alias(into))


def fit_axis(frames: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: status, n_fit_samples, n_features, explained_variance_ratio, components, mean.

    The first principal axis of all frames without a missing value, turned so that its components don't add up to less
    than 0. ``status``: ok, no_valid_effector_frames, or not_enough_effector_frames (under two); without an axis its
    figures are NULL. Only sums of products reach the driver.
    """
    n, s, p = models.vector_gram(frames, vector)
    width = len(s) or (frames.agg(F.max(F.size(vector))).first()[0] or 0)
    row = ("no_valid_effector_frames" if n == 0 else "not_enough_effector_frames", int(n), width, None, None, None)
    if n >= 2:
        mean, load, evr = models.principal_axes(n, s, p)
        row = ("ok", int(n), width, float(evr[0]), [float(x) for x in load[0]], [float(x) for x in mean])
    return frames.sparkSession.createDataFrame([row], "status string, n_fit_samples long, n_features int, explained_variance_ratio double, components array<double>, mean array<double>")


def _dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def scalar_signal(frames: DataFrame, axis: DataFrame, by: list[str], order: str, vector: str = "vector", into: str = "v") -> DataFrame:
    """(by, order, ``into``): frames projected on the fitted axis, gaps filled along the trajectory.

    Without a fitted axis a frame's signal is the mean of its values. A frame that misses a value (without an axis: all
    values) is a gap; a trajectory of gaps is 0 throughout.
    """
    joined = frames.crossJoin(F.broadcast(axis.select("status", "components", "mean")))  # one row
    values = F.array_compact(vector)
    plain = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values))
    projected = _dot(vector, "components") - _dot("mean", "components")
    signal = F.when(F.col("status") == "ok", projected).otherwise(plain)
    return T.gap_fill(joined.select(*by, order, signal.alias(into)), by, order, into)


def semantic_features(signal: DataFrame, by: list[str], order: str, value: str = "v") -> DataFrame:
    """Per trajectory: shares of the signal's three states, transitions a sample, entropy, final and most frequent state, prefixed ``semantic_``."""
    found = T.state_features(T.tercile_states(signal, by, value), by, order)
    return found.select(*by, *[F.col(c).alias(f"semantic_{c}") for c in found.columns if c not in by])


def skill_diversity(features: DataFrame, into: str = "C14") -> DataFrame:
    """C14: entropy of the three states' shares over ln 3; NULL without any share."""
    shares = [F.col(f"semantic_state_ratio_{i}") for i in range(3)]
    entropy = sum((F.when(s > 0, -s * F.ln(s + 1e-12)).otherwise(F.lit(0.0)) for s in shares), F.lit(0.0)) / F.ln(F.lit(3.0))
    return features.withColumn(into, F.when(F.greatest(*[F.coalesce(s, F.lit(0.0)) for s in shares]) > 0, entropy))


def path_l1(df: DataFrame, by: list[str], order: str, dim: str, value: str, into: str) -> DataFrame:
    """Per trajectory: the sum of all channels' absolute steps, 0 without any."""
    w = W.partitionBy(*by, dim).orderBy(order)
    steps = df.select(*by, F.abs(F.col(value) - F.lag(value).over(w)).alias("s"))
    return steps.groupBy(*by).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias(into))
