"""Rule-based labels with thresholds from the data, a review queue, and manual override."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinetrail.functions.columns import all_hold, reasons
from kinetrail.operators.order import table_quantiles
from kinetrail.operators.scoring import beside

#: signal: (quantile of the signal, least threshold, reason when below)
RULES: dict[str, tuple[float, float | None, str]] = {
    "duration_s": (0.10, 1.5, "duration_too_short"),
    "arm_range_l1": (0.30, None, "arm_motion_too_small"),
    "effector_range_l1": (0.35, None, "effector_range_too_small"),
    "effector_peak_offset_l1": (0.35, None, "no_clear_effector_event"),
    "stable_grasp_segment_s": (0.35, 0.20, "no_stable_grasp_segment"),
}


def thresholds(signals: DataFrame, rules: dict = RULES) -> DataFrame:
    """One row, a column min_<signal> for each rule."""
    cuts = table_quantiles(signals, {s: [q] for s, (q, _, _) in rules.items()})
    at = lambda s, least: cuts[s][0] if least is None else max(x for x in (cuts[s][0], least) if x is not None)
    return signals.sparkSession.range(1).select(*[F.lit(at(s, least)).cast("double").alias(f"min_{s}") for s, (_, least, _) in rules.items()])


def auto_label(signals: DataFrame, limits: DataFrame, rules: dict = RULES) -> DataFrame:
    """``signals`` with auto_label, review_needed, label_reason; a missing signal fails its rule."""
    checks: dict[str, Column] = {why: F.col(s) >= F.col(f"min_{s}") for s, (_, _, why) in rules.items()}
    ok = all_hold(checks)
    df = beside(signals, limits).withColumns({"auto_label": ok.cast("int"), "review_needed": ~ok, "label_reason": reasons(checks, "auto_success")})
    return df.drop(*[f"min_{s}" for s in rules])


def review_queue(labelled: DataFrame) -> DataFrame:
    """Rows with label 0 and blank columns for the reviewer."""
    return labelled.where("auto_label = 0").withColumns({"manual_label": F.lit(None).cast("int"), "review_note": F.lit("")})


def merge_manual(auto: DataFrame, manual: DataFrame, id_col: str, label: str, order: str | None = None) -> DataFrame:
    """``final_label``: the manual label where it's 0 or 1, else the automatic one.

    Of several manual rows for an id the last in ``order`` counts (default: the largest label), so nothing fans out.
    """
    own = manual.where(F.col(label).isin(0, 1)).select(F.col(id_col), F.col(label).alias("manual_label"), *([F.col(order).alias("_o")] if order else [F.col(label).alias("_o")]))
    own = own.withColumn("_r", F.row_number().over(W.partitionBy(id_col).orderBy(F.desc("_o"), F.desc("manual_label")))).where("_r = 1").drop("_r", "_o")
    return auto.join(own, id_col, "left").withColumn("final_label", F.coalesce("manual_label", "auto_label"))


def trajectory_errors(windows: DataFrame, id_col: str, scene: str, mse: str, mae: str, nmse: str) -> DataFrame:
    """Held-out errors of windows -> one row a trajectory: mean errors, ``trajectory_imitation_score`` = exp(-normalised error), windows.

    A trajectory lies in one scene; should its rows name several, the smallest stands. NULL errors don't count.
    """
    means = {"trajectory_mse": mse, "trajectory_mae": mae, "trajectory_normalized_mse": nmse}
    found = windows.groupBy(id_col).agg(F.min(scene).alias(scene), *[F.avg(c).alias(n) for n, c in means.items()], F.count("*").alias("n_bc_windows"))
    return found.withColumn("trajectory_imitation_score", F.exp(-F.col("trajectory_normalized_mse")))


def label_summary(labelled: DataFrame, scene: str) -> DataFrame:
    """By scene: trajectories, mean and sample deviation of normalised error and imitation score (NULL for a single one)."""
    columns = ("trajectory_normalized_mse", "trajectory_imitation_score")
    figures = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return labelled.groupBy(scene).agg(F.count("*").alias("n_trajectories"), *figures)
