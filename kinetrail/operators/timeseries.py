"""Sequence operators per trajectory: cleaning, grids, resampling, matching, motion, runs and windows.

``by`` names the trajectory's key columns. Windows partition by that key, so one trajectory's rows meet in one task
and different trajectories never do; nothing here needs an order across trajectories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinetrail.functions.columns import c, quantile

EPS = 1e-12


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c(ts).cast("timestamp_ntz"))


def first_of_each_time(df: DataFrame, by: list[str], time: str, order: str) -> DataFrame:
    """One row per timestamp: the first in ``order``."""
    w = W.partitionBy(*by, time).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def overlap(df: DataFrame, by: list[str], time: str, stream: str, streams: list[str]) -> DataFrame:
    """Per trajectory that has all ``streams``: start_t (latest start) and end_t (earliest end), where start_t <= end_t."""
    ends = df.where(F.col(stream).isin(streams)).groupBy(*by, stream).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    both = ends.groupBy(*by).agg(F.max("a").alias("start_t"), F.min("b").alias("end_t"), F.count("*").alias("n"))
    return both.where((F.col("n") == len(streams)) & (F.col("start_t") <= F.col("end_t"))).drop("n")


def regular_grid(bounds: DataFrame, by: list[str], step: float) -> DataFrame:
    """(by, k, t): t = k * step seconds after start_t, up to end_t; bounds in seconds."""
    last = F.floor((F.col("end_t") - F.col("start_t") + EPS) / step)
    return bounds.select(*by, "start_t", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k")).withColumn("t", F.col("k") * F.lit(float(step)))


def linear_resample(source: DataFrame, grid: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """``value`` of ``source`` on the grid (by, k, t): linear between samples, NULL outside, one sample repeats.

    One shuffle: samples and grid points meet in one sorted stream per trajectory, and each grid point takes the last
    sample before and the first after it.
    """
    points = source.where(F.col(value).isNotNull()).groupBy(*by, F.col(time).alias("t")).agg(F.min_by(value, value).alias("v"))
    both = points.select(*by, "t", "v", F.lit(None).cast("long").alias("k")).unionByName(grid.select(*by, "t", F.lit(None).cast("double").alias("v"), "k"))
    before = W.partitionBy(*by).orderBy("t", F.col("k").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(*by).orderBy("t", F.col("k").isNull()).rowsBetween(0, W.unboundedFollowing)
    # samples come before grid points at equal times looking back, and behind them looking forward
    own_t = F.when(F.col("v").isNotNull(), F.col("t"))
    seen = both.withColumns({
        "t0": F.last(own_t, True).over(before), "v0": F.last("v", True).over(before),
        "t1": F.first(own_t, True).over(after), "v1": F.first("v", True).over(after),
        "n": F.count("v").over(W.partitionBy(*by)), "only": F.max("v").over(W.partitionBy(*by)),
    })
    between = F.when(F.col("t1") == F.col("t0"), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("t") - F.col("t0")) / F.nullif(F.col("t1") - F.col("t0"), F.lit(0.0)))
    return seen.where("k is not null").select(*by, "k", "t", F.when(F.col("n") == 1, F.col("only")).otherwise(between).alias(value))


def gap_fill(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Gaps filled: linear inside (in steps of row number), the nearest value at the edges, 0 if all is missing."""
    df = df.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(order)).cast("double"))
    back = W.partitionBy(*by).orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*by).orderBy("_i").rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col("_i"))
    df = df.withColumns({"_i0": F.last(at, True).over(back), "_v0": F.last(value, True).over(back), "_i1": F.first(at, True).over(ahead), "_v1": F.first(value, True).over(ahead)})
    inner = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_i") - F.col("_i0")) / F.nullif(F.col("_i1") - F.col("_i0"), F.lit(0.0))
    filled = F.coalesce(F.col(value), inner, F.col("_v0"), F.col("_v1"), F.lit(0.0))
    return df.withColumn(value, filled).drop("_i", "_i0", "_v0", "_i1", "_v1")


def nearest_match(frames: DataFrame, bounds: DataFrame, by: list[str], frame: str, time: str, step: float) -> DataFrame:
    """Frames within [start_t, end_t] matched to the nearest grid point; a tie goes to the earlier point.

    The grid is regular, so the nearest point is arithmetic: no grid rows, no as-of join, just the join with one
    row of bounds per trajectory. Gives (by, frame, rel_t, k, grid_t, offset_s).
    """
    last = F.floor((F.col("end_t") - F.col("start_t") + EPS) / step)
    df = frames.join(bounds.select(*by, "start_t", "end_t"), by).where(F.col(time).between(F.col("start_t"), F.col("end_t")))
    df = df.withColumns({"rel_t": F.col(time) - F.col("start_t"), "_last": last}).withColumn("_k", F.floor(F.col("rel_t") / step))
    near = [F.struct(F.abs(F.col("rel_t") - k * F.lit(float(step))).alias("d"), k.alias("k")) for k in (F.least(F.greatest(F.col("_k") + i, F.lit(0).cast("long")), F.col("_last")) for i in (-1, 0, 1))]
    df = df.withColumn("_best", F.array_min(F.array(*near)))
    grid_t = F.col("_best.k") * F.lit(float(step))
    return df.select(*by, frame, "rel_t", F.col("_best.k").alias("k"), grid_t.alias("grid_t"), (F.col("rel_t") - grid_t).alias("offset_s"))


def align_summary(matches: DataFrame, bounds: DataFrame, by: list[str], stream: str, streams: list[str], step: float) -> DataFrame:
    """Per trajectory: grid length and duration, and per stream the number of matches and mean offset in ms."""
    wide = matches.groupBy(*by).pivot(stream, streams).agg(F.count(F.lit(1)).alias("matched_n"), F.avg(F.abs("offset_s") * 1000).alias("mean_offset_ms"))
    length = F.floor((F.col("end_t") - F.col("start_t") + EPS) / step) + 1
    base = bounds.select(*by, length.alias("aligned_len"), ((length - 1) * F.lit(float(step))).alias("aligned_duration_s"))
    return base.join(wide, by, "left").fillna(0, [f"{s}_matched_n" for s in streams])


def motion_stats(df: DataFrame, by: list[str], order: list[str], value: str, dt: float = 1.0) -> DataFrame:
    """Mean, std (ddof 0), range, mean |velocity|, jerk energy and path length in one pass over one sorted window.

    Under 2 samples velocity is NULL and the path 0; under 4 jerk energy is NULL.
    """
    w = W.partitionBy(*by).orderBy(*order)
    v, (a, b, d) = F.col(value), [F.lag(value, i).over(w) for i in (1, 2, 3)]
    steps = df.select(*by, v.alias("v"), (v - a).alias("d1"), ((v - 3 * a + 3 * b - d) / dt**3).alias("jerk"))
    n = F.count("*")
    return steps.groupBy(*by).agg(
        n.alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"),
        (F.max("v") - F.min("v")).alias("range"),
        (F.avg(F.abs("d1")) / dt).alias("vel_abs_mean"),
        F.when(n >= 4, F.coalesce(F.sum(F.col("jerk") * F.col("jerk") * dt), F.lit(0.0))).alias("jerk_energy"),
        F.coalesce(F.sum(F.abs("d1")), F.lit(0.0)).alias("path_l1"),
    )


def tercile_states(df: DataFrame, by: list[str], value: str, low: float = 0.333, high: float = 0.667) -> DataFrame:
    """``state`` 0, 1 or 2 by the trajectory's own quantiles (strictly above)."""
    cuts = df.groupBy(*by).agg(quantile(value, [low, high]).alias("_q"))
    return df.join(cuts, by).withColumn("state", F.when(F.col(value) > F.col("_q")[1], 2).when(F.col(value) > F.col("_q")[0], 1).otherwise(0)).drop("_q")


def state_features(df: DataFrame, by: list[str], order: str, state: str = "state", n_states: int = 3) -> DataFrame:
    """State ratios, transitions per sample, entropy, the final state and the most frequent (the smallest of ties)."""
    w = W.partitionBy(*by).orderBy(order)
    steps = df.select(*by, order, F.col(state).alias("s"), (F.col(state) != F.lag(state).over(w)).alias("moved"))
    ratio = [F.avg((F.col("s") == i).cast("double")) for i in range(n_states)]
    counts = [F.count_if(F.col("s") == i) for i in range(n_states)]
    best = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("i")) for i, n in enumerate(counts)]))
    entropy = sum((F.when(r > 0, -r * F.ln(r)).otherwise(F.lit(0.0)) for r in ratio), F.lit(0.0))
    return steps.groupBy(*by).agg(
        *[r.alias(f"state_ratio_{i}") for i, r in enumerate(ratio)],
        (F.count_if("moved") / F.count("*")).alias("transition_rate"),
        entropy.alias("entropy"),
        F.max_by("s", order).alias("final_state"),
        (-best["i"]).alias("dominant_state"),
    )


def head_tail_stats(df: DataFrame, by: list[str], order: list[str], value: str, share: float = 0.1, least: int = 10) -> DataFrame:
    """Mean and std (ddof 0) of the first and last min(n, max(least, floor(share n))) samples."""
    w = W.partitionBy(*by)
    up, down = [F.row_number().over(w.orderBy(*[f(x) for x in order])) for f in (F.asc, F.desc)]
    n = F.count("*").over(w)
    df = df.select(*by, value, up.alias("i"), down.alias("j"), F.least(n, F.greatest(F.lit(least), F.floor(n * share))).alias("m"))
    head, tail = F.when(F.col("i") <= F.col("m"), F.col(value)), F.when(F.col("j") <= F.col("m"), F.col(value))
    return df.groupBy(*by).agg(F.avg(head).alias("head_mean"), F.stddev_pop(head).alias("head_std"), F.avg(tail).alias("tail_mean"), F.stddev_pop(tail).alias("tail_std"))


def longest_run(df: DataFrame, by: list[str], order: list[str], flag: str) -> DataFrame:
    """``longest``: the most consecutive rows with a true flag, 0 if none (gaps and islands)."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    on = F.coalesce(F.col(flag), F.lit(False))
    islands = df.select(*by, on.alias("on"), F.sum((~on).cast("int")).over(w).alias("island"))
    return islands.groupBy(*by, "island").agg(F.count_if("on").alias("n")).groupBy(*by).agg(F.max("n").alias("longest"))


def event_signals(df: DataFrame, by: list[str], order: list[str], value: str, step_s: float = 0.01, moved_share: float = 0.6, still: float = 0.4, share: float = 0.1, least: int = 10) -> DataFrame:
    """Of one channel: peak offset from the start pose, active share, longest stable stretch away from the start, range.

    Moved: at least ``moved_share`` of the peak offset. Stable: speed at most the ``still`` quantile of the
    trajectory's speeds. Missing samples are neither moved nor stable.
    """
    w = W.partitionBy(*by).orderBy(*order)
    start = head_tail_stats(df, by, order, value, share, least).select(*by, "head_mean")
    middle = df.groupBy(*by).agg(quantile(value, 0.5).alias("_mid"), (F.max(value) - F.min(value)).alias("range"))
    first = F.row_number().over(w) == 1
    speed = F.when(first & F.col(value).isNotNull(), F.lit(0.0)).otherwise(F.abs(F.col(value) - F.lag(value).over(w)))
    rows = df.select(*by, *order, F.col(value).alias("v"), speed.alias("speed")).join(start.join(middle, by), by)
    rows = rows.withColumn("offset", F.abs(F.col("v") - F.coalesce("head_mean", "_mid")))
    peaks = rows.groupBy(*by).agg(F.max("offset").alias("peak"), quantile("speed", still).alias("calm"), F.max("range").alias("range"))
    rows = rows.drop("range").join(peaks, by).withColumn("moved", (F.col("offset") >= moved_share * F.col("peak")) & (F.col("peak") > 1e-8))
    rows = rows.withColumn("held", F.col("moved") & (F.col("speed") <= F.col("calm")))
    runs = longest_run(rows, by, order, "held")
    found = rows.groupBy(*by).agg(
        F.max(F.when(F.col("peak") > 1e-8, F.col("peak")).otherwise(F.lit(0.0))).alias("peak_offset_l1"),
        F.coalesce(F.avg(F.when(F.col("v").isNotNull(), F.col("moved").cast("double"))), F.lit(0.0)).alias("active_ratio"),
        F.coalesce(F.max("range"), F.lit(0.0)).alias("range_l1"),
    )
    return found.join(runs, by).select(*by, F.coalesce("peak_offset_l1", F.lit(0.0)).alias("peak_offset_l1"), "active_ratio", "range_l1", F.col("longest").alias("stable_len"), (F.col("longest") * F.lit(step_s)).alias("stable_s"))


def sliding_windows(df: DataFrame, by: list[str], order: list[str], x: list[str], y: list[str], size: int = 5, stride: int = 2) -> DataFrame:
    """(by, i, x, y): every ``stride``-th window of ``size`` samples, flattened, with the last sample's target.

    Windows with a missing value are left out; ``i`` counts those that stay.
    """
    w = W.partitionBy(*by).orderBy(*order)
    row = F.array(*[F.col(n).cast("double") for n in x])
    df = df.select(*by, *order, F.row_number().over(w).alias("_n"), F.collect_list(row).over(w.rowsBetween(1 - size, 0)).alias("_w"), F.array(*[F.col(n).cast("double") for n in y]).alias("y"))
    df = df.where((F.col("_n") >= size) & ((F.col("_n") - size) % stride == 0)).withColumn("x", F.flatten("_w"))
    whole = ~F.exists("x", lambda v: v.isNull() | F.isnan(v)) & ~F.exists("y", lambda v: v.isNull() | F.isnan(v))
    return df.where(whole).select(*by, (F.row_number().over(W.partitionBy(*by).orderBy("_n")) - 1).alias("i"), "x", "y")


def timestamp_consistency(df: DataFrame, by: list[str], time: str, order: str) -> DataFrame:
    """Mean of the share of rising steps and the share of steps within 3 median steps, in file order; NULL under 2 rows."""
    w = W.partitionBy(*by).orderBy(order)
    steps = df.select(*by, (F.col(time) - F.lag(time).over(w)).cast("double").alias("d"))
    middle = steps.where("d > 0").groupBy(*by).agg(quantile("d", 0.5).alias("m"))
    steps = steps.join(middle, by, "left")
    rises = F.avg((F.col("d") > 0).cast("double"))
    steady = F.avg(((F.col("d") > 0) & F.coalesce(F.col("d") <= 3 * F.col("m"), F.lit(False))).cast("double"))
    return steps.where("d is not null").groupBy(*by).agg(F.when(F.max("m").isNull(), F.lit(0.0)).otherwise((rises + steady) / 2).alias("consistency"))


def robust_z(df: DataFrame, by: list[str], values: dict[str, str]) -> DataFrame:
    """``values``: {column: name of its z}. 0.6745 (x - median) / MAD; if the MAD is 0 the plain z-score, if the spread is 0
    too then 0. NULL stays NULL. All columns share the two aggregates.
    """
    mids = [x for c_ in values for x in (quantile(c_, 0.5).alias(f"_m_{c_}"), F.avg(c_).alias(f"_a_{c_}"), F.stddev_pop(c_).alias(f"_s_{c_}"))]
    df = df.join(df.groupBy(*by).agg(*mids), by)
    df = df.join(df.groupBy(*by).agg(*[quantile(F.abs(F.col(c_) - F.col(f"_m_{c_}")), 0.5).alias(f"_d_{c_}") for c_ in values]), by)
    for c_, z in values.items():
        m, a, s, d = (F.col(f"_{k}_{c_}") for k in "masd")
        df = df.withColumn(z, F.when(d > EPS, 0.6745 * (F.col(c_) - m) / d).when(s > EPS, (F.col(c_) - a) / s).when(F.col(c_).isNotNull(), F.lit(0.0)))
    return df.drop(*[f"_{k}_{c_}" for k in "masd" for c_ in values])


def anomaly_quality(df: DataFrame, by: list[str], order: list[str], value: str, bound: float = 3.5) -> DataFrame:
    """1 - share of steps whose |first|, |second| or |third| difference is a robust outlier; NULL under 4 samples."""
    w = W.partitionBy(*by).orderBy(*order)
    v, (a, b, d) = F.col(value), [F.lag(value, i).over(w) for i in (1, 2, 3)]
    steps = df.select(*by, F.row_number().over(w).alias("i"), F.abs(v - a).alias("s1"), F.abs(v - 2 * a + b).alias("s2"), F.abs(v - 3 * a + 3 * b - d).alias("s3"))
    steps = robust_z(steps, by, {"s1": "z1", "s2": "z2", "s3": "z3"})
    odd = F.coalesce(F.abs("z1") > bound, F.lit(False)) | F.coalesce(F.abs("z2") > bound, F.lit(False)) | F.coalesce(F.abs("z3") > bound, F.lit(False))
    share = F.avg(F.when(F.col("i") > 1, odd.cast("double")))
    return steps.groupBy(*by).agg(F.when(F.count("*") >= 4, 1 - share).alias("anomaly_quality"))


def noise_quality(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """1 - E2 / (E2 + E) with E2 the energy of second differences and E of the centred signal; 1 without energy."""
    w = W.partitionBy(*by).orderBy(*order)
    second = F.col(value) - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w)
    rows = df.select(*by, F.col(value).alias("v"), second.alias("d2"), F.avg(value).over(W.partitionBy(*by)).alias("m"))
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("v") - F.col("m")) ** 2), F.lit(0.0)).alias("e"), F.coalesce(F.sum(F.col("d2") ** 2), F.lit(0.0)).alias("e2"))
    return found.select(*by, F.when(F.col("n") < 4, None).when(F.col("e") <= EPS, F.lit(1.0)).otherwise(1 - F.col("e2") / (F.col("e2") + F.col("e"))).alias("noise_quality"))
