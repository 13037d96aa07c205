"""Registered queries of the sequence operators over ``events`` and ``lineitem``, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.functions import columns as C
from kinetrail.operators import labels as L
from kinetrail.operators import scoring as S
from kinetrail.operators import timeseries as T

BY, ORDER = ["user_id"], ["us", "event_id"]
STEP = 21_600.0  # six hours


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return C.nan_to_null(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", T.micros("ts").alias("us"), "value")


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    """Doubles rounded, and -0.0 made 0.0, so that sums in another order compare equal.

    Rounded as the SQL twins do: the double multiplied, made whole and divided. Rounding its decimal form instead leaves
    doubles just below a half on the other side.
    """
    names = only or [n for n, t in df.dtypes if t == "double"]
    by = F.lit(10.0**digits)
    return df.withColumns({n: F.round(F.col(n) * by) / by + F.lit(0.0) for n in names})


E_SQL = "e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us, value FROM events)"
STEPS_SQL = f"""{E_SQL}, s AS (SELECT *, value - lag(value) OVER w AS d1,
    value - 3 * lag(value) OVER w + 3 * lag(value, 2) OVER w - lag(value, 3) OVER w AS j
    FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))"""


def motion_stats(spark, sf_dir):
    return rounded(T.motion_stats(events(spark, sf_dir), BY, ORDER, "value").drop("jerk_energy"))


def jerk_energy(spark, sf_dir):
    return rounded(T.motion_stats(events(spark, sf_dir), BY, ORDER, "value").select("user_id", "jerk_energy"), 3)


def vector_motion_stats(spark, sf_dir):
    dims = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", T.micros("l_shipdate").alias("us"), "l_orderkey", "l_linenumber", *dims)
    long = rows.unpivot(["l_suppkey", "us", "l_orderkey", "l_linenumber"], dims, "dim", "v")
    return rounded(T.motion_stats(long, ["l_suppkey", "dim"], ["us", "l_orderkey", "l_linenumber"], "v").drop("jerk_energy"), 4)


def dedup_timestamps(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("hour", F.floor(F.col("us") / 3_600_000_000))
    return T.first_of_each_time(rows, BY, "hour", "event_id").select("user_id", "hour", "event_id", "value")


def _bounds(spark, sf_dir):
    """Overlap of a user's views and clicks, in seconds."""
    rows = events(spark, sf_dir).withColumn("t", F.col("us") / 1e6)
    return rows, T.overlap(rows, BY, "t", "event_type", ["view", "click"])


BOUNDS_SQL = f"""{E_SQL}, t AS (SELECT *, us / 1e6 AS t FROM e), m AS (SELECT user_id, event_type, min(t) AS a, max(t) AS b
    FROM t WHERE event_type IN ('view', 'click') GROUP BY ALL), bounds AS (SELECT user_id, max(a) AS start_t, min(b) AS end_t
    FROM m GROUP BY user_id HAVING count(*) = 2 AND max(a) <= min(b)),
    grid AS (SELECT user_id, start_t, unnest(range(0, CAST(floor((end_t - start_t + 1e-12) / {STEP}) AS BIGINT) + 1)) AS k FROM bounds)"""


def common_grid(spark, sf_dir):
    return T.regular_grid(_bounds(spark, sf_dir)[1], BY, STEP).select("user_id", "k", "t")


def linear_resample(spark, sf_dir):
    rows, bounds = _bounds(spark, sf_dir)
    grid = T.regular_grid(bounds, BY, STEP).withColumn("t", F.col("start_t") + F.col("t"))
    found = T.linear_resample(rows.where("event_type = 'view'"), grid, BY, "t", "value")
    return rounded(found.select("user_id", "k", "value"))


def gap_fill(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return rounded(T.gap_fill(rows, BY, "event_id", "value").select("user_id", "event_id", "value"))


def _matches(spark, sf_dir):
    rows, bounds = _bounds(spark, sf_dir)
    frames = rows.where("event_type NOT IN ('view', 'click')").select("user_id", "event_id", "event_type", "t")
    return T.nearest_match(frames, bounds, BY, "event_id", "t", STEP).join(frames.select("event_id", "event_type"), "event_id"), bounds


MATCH_SQL = f"""{BOUNDS_SQL}, f AS (SELECT t.user_id, event_id, event_type, t - start_t AS rel_t, floor((end_t - start_t + 1e-12) / {STEP}) AS last
    FROM t JOIN bounds USING (user_id) WHERE event_type NOT IN ('view', 'click') AND t BETWEEN start_t AND end_t),
    c AS (SELECT *, greatest(0, least(last, floor(rel_t / {STEP}) + unnest([-1, 0, 1]))) AS k FROM f),
    match AS (SELECT user_id, event_id, any_value(event_type) AS event_type, any_value(rel_t) AS rel_t,
        CAST(arg_min(k, abs(rel_t - k * {STEP}) * 1e6 + k * 1e-6) AS BIGINT) AS k FROM c GROUP BY ALL)"""


def nearest_match(spark, sf_dir):
    found, _ = _matches(spark, sf_dir)
    return rounded(found.select("user_id", "event_id", "k", "offset_s"), 5)


def align_summary(spark, sf_dir):
    found, bounds = _matches(spark, sf_dir)
    return rounded(T.align_summary(found, bounds, BY, "event_type", ["purchase", "signup"], STEP), 3)


def multimodal_alignment(spark, sf_dir):
    """1 - mean over streams of the mean |offset|, relative to a step; within [0, 1]."""
    found, _ = _matches(spark, sf_dir)
    streams = found.groupBy("user_id", "event_type").agg(F.avg(F.abs("offset_s")).alias("o")).groupBy("user_id").agg(F.avg("o").alias("o"))
    return rounded(streams.select("user_id", C.clip(1 - F.col("o") / STEP).alias("alignment")))


def tercile_states(spark, sf_dir):
    states = T.tercile_states(events(spark, sf_dir), BY, "value")
    return rounded(T.state_features(states.withColumn("o", F.struct("us", "event_id")), BY, "o"))


def head_tail_stats(spark, sf_dir):
    return rounded(T.head_tail_stats(events(spark, sf_dir), BY, ORDER, "value"))


def longest_run(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("low", F.col("value") < 50)
    return T.longest_run(rows, BY, ORDER, "low")


def event_signals(spark, sf_dir):
    return rounded(T.event_signals(events(spark, sf_dir), BY, ORDER, "value"))


SIGNALS_SQL = f"""{E_SQL}, r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, abs(value - lag(value) OVER w) AS d
    FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
    h AS (SELECT user_id, avg(value) FILTER (i <= least(n, greatest(10, floor(n * 0.1)))) AS c, max(value) - min(value) AS rng FROM r GROUP BY user_id),
    o AS (SELECT r.*, rng, abs(value - c) AS off, CASE WHEN i = 1 THEN 0 ELSE d END AS speed FROM r JOIN h USING (user_id)),
    p AS (SELECT user_id, max(off) AS peak, quantile_cont(speed, 0.4) AS calm FROM o GROUP BY user_id),
    g AS (SELECT o.*, peak, peak > 1e-8 AND off >= 0.6 * peak AS moved, peak > 1e-8 AND off >= 0.6 * peak AND speed <= calm AS held FROM o JOIN p USING (user_id)),
    q AS (SELECT *, sum(CASE WHEN held THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM g),
    runs AS (SELECT user_id, max(c) AS longest FROM (SELECT user_id, island, count(*) FILTER (held) AS c FROM q GROUP BY ALL) GROUP BY user_id),
    signals AS (SELECT user_id, CASE WHEN max(peak) > 1e-8 THEN max(peak) ELSE 0.0 END AS peak_offset_l1, avg(CAST(moved AS DOUBLE)) AS active_ratio,
        max(rng) AS range_l1, max(longest) AS stable_len, max(longest) * CAST(0.01 AS DOUBLE) AS stable_s FROM g JOIN runs USING (user_id) GROUP BY user_id)"""


def _label_signals(spark, sf_dir):
    rows = events(spark, sf_dir)
    signals = T.event_signals(rows, BY, ORDER, "value")
    length = rows.groupBy("user_id").agg((F.count("*") * F.lit(0.03)).alias("duration_s"), F.stddev_pop("value").alias("arm_range_l1"))
    joined = signals.join(length, "user_id")
    return joined.select("user_id", "duration_s", "arm_range_l1", F.col("range_l1").alias("effector_range_l1"), F.col("peak_offset_l1").alias("effector_peak_offset_l1"), (F.col("stable_s") * 10).alias("stable_grasp_segment_s"))


LABEL_SIGNALS_SQL = f"""{SIGNALS_SQL}, ls AS (SELECT user_id, count(*) * CAST(0.03 AS DOUBLE) AS duration_s, stddev_pop(value) AS arm_range_l1 FROM e GROUP BY user_id),
    sig AS (SELECT user_id, duration_s, arm_range_l1, range_l1 AS effector_range_l1, peak_offset_l1 AS effector_peak_offset_l1,
        stable_s * 10 AS stable_grasp_segment_s FROM signals JOIN ls USING (user_id)),
    lim AS (SELECT greatest(quantile_cont(duration_s, 0.1), CAST(1.5 AS DOUBLE)) AS min_duration_s, quantile_cont(arm_range_l1, 0.3) AS min_arm_range_l1,
        quantile_cont(effector_range_l1, 0.35) AS min_effector_range_l1, quantile_cont(effector_peak_offset_l1, 0.35) AS min_effector_peak_offset_l1,
        greatest(quantile_cont(stable_grasp_segment_s, 0.35), CAST(0.2 AS DOUBLE)) AS min_stable_grasp_segment_s FROM sig)"""


def label_thresholds(spark, sf_dir):
    return rounded(L.thresholds(_label_signals(spark, sf_dir)))


def auto_label(spark, sf_dir):
    signals = rounded(_label_signals(spark, sf_dir), 9)
    found = L.auto_label(signals, rounded(L.thresholds(signals), 9))
    return found.select("user_id", "auto_label", "review_needed", "label_reason")


def sliding_windows(spark, sf_dir):
    """Windows of five values with the last as target, as sums by window."""
    found = T.sliding_windows(events(spark, sf_dir), BY, ORDER, ["value"], ["value"])
    total = F.aggregate("x", F.lit(0.0), lambda s, x: s + x)
    return rounded(found.select("user_id", F.col("i").cast("long").alias("i"), F.size("x").cast("long").alias("n"), total.alias("x_sum"), F.col("y")[0].alias("y")))


def timestamp_consistency(spark, sf_dir):
    return rounded(T.timestamp_consistency(events(spark, sf_dir), ["user_id", "event_type"], "us", "event_id").where("consistency is not null"))


def robust_anomaly(spark, sf_dir):
    return rounded(T.anomaly_quality(events(spark, sf_dir), BY, ORDER, "value"))


def joint_noise(spark, sf_dir):
    return rounded(T.noise_quality(events(spark, sf_dir), BY, ORDER, "value"))


def joint_coordination(spark, sf_dir):
    return rounded(S.channel_coordination(table(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


def quantile_nmi(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("g", F.col("user_id") % 10)
    rows = S.quantile_bins(S.quantile_bins(rows, ["g"], "value", 5, "a"), ["g"], "us", 5, "b")
    return rounded(S.mutual_information(rows, ["g"], "a", "b"))


QUERIES = {
    f.__name__: f
    for f in (
        motion_stats, jerk_energy, vector_motion_stats, dedup_timestamps, common_grid, linear_resample, gap_fill, nearest_match, align_summary,
        multimodal_alignment, tercile_states, head_tail_stats, longest_run, event_signals, label_thresholds, auto_label, sliding_windows,
        timestamp_consistency, robust_anomaly, joint_noise, joint_coordination, quantile_nmi,
    )
}

ORACLE_SQL = {
    "motion_stats": f"""WITH {STEPS_SQL} SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
        round(max(value) - min(value), 6) AS "range", round(avg(abs(d1)), 6) AS vel_abs_mean, round(coalesce(sum(abs(d1)), 0), 6) AS path_l1 FROM s GROUP BY user_id""",
    "jerk_energy": f"WITH {STEPS_SQL} SELECT user_id, CASE WHEN count(*) >= 4 THEN round(coalesce(sum(j * j), 0), 3) END AS jerk_energy FROM s GROUP BY user_id",
    "vector_motion_stats": """WITH l AS (UNPIVOT (SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
        ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME dim VALUE v),
        s AS (SELECT *, v - lag(v) OVER (PARTITION BY l_suppkey, dim ORDER BY l_shipdate, l_orderkey, l_linenumber) AS d1 FROM l)
        SELECT l_suppkey, dim, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(max(v) - min(v), 4) AS "range",
        round(avg(abs(d1)), 4) AS vel_abs_mean, round(coalesce(sum(abs(d1)), 0), 4) AS path_l1 FROM s GROUP BY ALL""",
    "dedup_timestamps": f"""WITH {E_SQL}, h AS (SELECT *, CAST(floor(us / 3600000000) AS BIGINT) AS hour FROM e)
        SELECT user_id, hour, event_id, value FROM h QUALIFY row_number() OVER (PARTITION BY user_id, hour ORDER BY event_id) = 1""",
    "common_grid": f"WITH {BOUNDS_SQL} SELECT user_id, k, k * CAST({STEP} AS DOUBLE) AS t FROM grid",
    "linear_resample": f"""WITH {BOUNDS_SQL}, g AS (SELECT user_id, k, start_t + k * CAST({STEP} AS DOUBLE) AS t FROM grid),
        v AS (SELECT user_id, t, min(value) AS v FROM t WHERE event_type = 'view' GROUP BY ALL),
        lo AS (SELECT g.user_id, k, g.t, v.t AS t0, v.v AS v0 FROM g ASOF LEFT JOIN v ON g.user_id = v.user_id AND g.t >= v.t),
        hi AS (SELECT g.user_id, k, v.t AS t1, v.v AS v1 FROM g ASOF LEFT JOIN v ON g.user_id = v.user_id AND g.t <= v.t),
        n AS (SELECT user_id, count(*) AS n, min(v) AS sole FROM v GROUP BY user_id)
        SELECT lo.user_id, lo.k, round(CASE WHEN n = 1 THEN sole WHEN t0 = t1 THEN v0 ELSE v0 + (v1 - v0) * (t - t0) / (t1 - t0) END, 6) AS value
        FROM lo JOIN hi USING (user_id, k) JOIN n USING (user_id)""",
    "gap_fill": f"""WITH {E_SQL}, r AS (SELECT user_id, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS i FROM e),
        w AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0,
        first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1 FROM r
        WINDOW b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
        SELECT user_id, event_id, round(coalesce(v, v0 + (v1 - v0) * (i - i0) / nullif(i1 - i0, 0), v0, v1, 0), 6) AS value FROM w""",
    "nearest_match": f"WITH {MATCH_SQL} SELECT user_id, event_id, k, round(rel_t - k * {STEP}, 5) AS offset_s FROM match",
    "align_summary": f"""WITH {MATCH_SQL}, a AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS purchase_matched_n, count(*) FILTER (event_type = 'signup') AS signup_matched_n,
        round(avg(abs(rel_t - k * {STEP}) * 1000) FILTER (event_type = 'purchase'), 3) AS purchase_mean_offset_ms, round(avg(abs(rel_t - k * {STEP}) * 1000) FILTER (event_type = 'signup'), 3) AS signup_mean_offset_ms
        FROM match GROUP BY user_id), b AS (SELECT user_id, CAST(floor((end_t - start_t + 1e-12) / {STEP}) AS BIGINT) + 1 AS n FROM bounds)
        SELECT b.user_id, n AS aligned_len, CAST((n - 1) * {STEP} AS DOUBLE) AS aligned_duration_s, coalesce(purchase_matched_n, 0) AS purchase_matched_n, purchase_mean_offset_ms,
        coalesce(signup_matched_n, 0) AS signup_matched_n, signup_mean_offset_ms FROM b LEFT JOIN a USING (user_id)""",
    "multimodal_alignment": f"""WITH {MATCH_SQL}, s AS (SELECT user_id, event_type, avg(abs(rel_t - k * {STEP})) AS o FROM match GROUP BY ALL)
        SELECT user_id, round(greatest(0, least(1, 1 - avg(o) / {STEP})), 6) AS alignment FROM s GROUP BY user_id""",
    "tercile_states": f"""WITH {E_SQL}, q AS (SELECT user_id, quantile_cont(value, 0.333) AS a, quantile_cont(value, 0.667) AS b FROM e GROUP BY user_id),
        s AS (SELECT e.*, CASE WHEN value > b THEN 2 WHEN value > a THEN 1 ELSE 0 END AS s FROM e JOIN q USING (user_id)),
        m AS (SELECT *, s <> lag(s) OVER (PARTITION BY user_id ORDER BY us, event_id) AS moved FROM s),
        r AS (SELECT user_id, avg(CAST(s = 0 AS DOUBLE)) AS r0, avg(CAST(s = 1 AS DOUBLE)) AS r1, avg(CAST(s = 2 AS DOUBLE)) AS r2, count(*) FILTER (moved) / CAST(count(*) AS DOUBLE) AS tr,
        last(s ORDER BY us, event_id) AS fin FROM m GROUP BY user_id)
        SELECT user_id, round(r0, 6) AS state_ratio_0, round(r1, 6) AS state_ratio_1, round(r2, 6) AS state_ratio_2, round(tr, 6) AS transition_rate,
        round(-(CASE WHEN r0 > 0 THEN r0 * ln(r0) ELSE 0 END + CASE WHEN r1 > 0 THEN r1 * ln(r1) ELSE 0 END + CASE WHEN r2 > 0 THEN r2 * ln(r2) ELSE 0 END), 6) AS entropy,
        fin AS final_state, CASE WHEN r0 >= r1 AND r0 >= r2 THEN 0 WHEN r1 >= r2 THEN 1 ELSE 2 END AS dominant_state FROM r""",
    "head_tail_stats": f"""WITH {E_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS j,
        count(*) OVER (PARTITION BY user_id) AS n FROM e), m AS (SELECT *, least(n, greatest(10, floor(n * 0.1))) AS m FROM r)
        SELECT user_id, round(avg(value) FILTER (i <= m), 6) AS head_mean, round(stddev_pop(value) FILTER (i <= m), 6) AS head_std,
        round(avg(value) FILTER (j <= m), 6) AS tail_mean, round(stddev_pop(value) FILTER (j <= m), 6) AS tail_std FROM m GROUP BY user_id""",
    "longest_run": f"""WITH {E_SQL}, i AS (SELECT *, value < 50 AS low, sum(CASE WHEN value < 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e),
        c AS (SELECT user_id, island, count(*) FILTER (low) AS n FROM i GROUP BY ALL) SELECT user_id, max(n) AS longest FROM c GROUP BY user_id""",
    "event_signals": f"""WITH {SIGNALS_SQL} SELECT user_id, round(peak_offset_l1, 6) AS peak_offset_l1, round(active_ratio, 6) AS active_ratio, round(range_l1, 6) AS range_l1,
        stable_len, round(stable_s, 6) AS stable_s FROM signals""",
    "label_thresholds": f"""WITH {LABEL_SIGNALS_SQL} SELECT round(min_duration_s, 6) AS min_duration_s, round(min_arm_range_l1, 6) AS min_arm_range_l1, round(min_effector_range_l1, 6) AS min_effector_range_l1,
        round(min_effector_peak_offset_l1, 6) AS min_effector_peak_offset_l1, round(min_stable_grasp_segment_s, 6) AS min_stable_grasp_segment_s FROM lim""",
    "auto_label": f"""WITH {LABEL_SIGNALS_SQL}, x AS (SELECT user_id, round(duration_s, 9) >= round(min_duration_s, 9) AS c1, round(arm_range_l1, 9) >= round(min_arm_range_l1, 9) AS c2,
        round(effector_range_l1, 9) >= round(min_effector_range_l1, 9) AS c3, round(effector_peak_offset_l1, 9) >= round(min_effector_peak_offset_l1, 9) AS c4,
        round(stable_grasp_segment_s, 9) >= round(min_stable_grasp_segment_s, 9) AS c5 FROM sig, lim)
        SELECT user_id, CASE WHEN c1 AND c2 AND c3 AND c4 AND c5 THEN 1 ELSE 0 END AS auto_label, NOT (c1 AND c2 AND c3 AND c4 AND c5) AS review_needed,
        CASE WHEN c1 AND c2 AND c3 AND c4 AND c5 THEN 'auto_success' ELSE concat_ws('|', CASE WHEN NOT c1 THEN 'duration_too_short' END, CASE WHEN NOT c2 THEN 'arm_motion_too_small' END,
        CASE WHEN NOT c3 THEN 'effector_range_too_small' END, CASE WHEN NOT c4 THEN 'no_clear_effector_event' END, CASE WHEN NOT c5 THEN 'no_stable_grasp_segment' END) END AS label_reason FROM x""",
    "sliding_windows": f"""WITH {E_SQL}, w AS (SELECT user_id, value, row_number() OVER w AS n, sum(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS s
        FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
        SELECT user_id, CAST((n - 5) / 2 AS BIGINT) AS i, CAST(5 AS BIGINT) AS n, round(s, 6) AS x_sum, round(value, 6) AS y FROM w WHERE n >= 5 AND (n - 5) % 2 = 0""",
    "timestamp_consistency": f"""WITH {E_SQL}, s AS (SELECT user_id, event_type, CAST(us - lag(us) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS DOUBLE) AS d FROM e),
        m AS (SELECT user_id, event_type, quantile_cont(d, 0.5) AS m FROM s WHERE d > 0 GROUP BY ALL)
        SELECT user_id, event_type, round(CASE WHEN max(m) IS NULL THEN 0 ELSE (avg(CAST(d > 0 AS DOUBLE)) + avg(CAST(d > 0 AND d <= 3 * m AS DOUBLE))) / 2 END, 6) AS consistency
        FROM s LEFT JOIN m USING (user_id, event_type) WHERE d IS NOT NULL GROUP BY ALL""",
    "robust_anomaly": f"""WITH {E_SQL}, s AS (SELECT user_id, row_number() OVER w AS i, abs(value - lag(value) OVER w) AS s1, abs(value - 2 * lag(value) OVER w + lag(value, 2) OVER w) AS s2,
        abs(value - 3 * lag(value) OVER w + 3 * lag(value, 2) OVER w - lag(value, 3) OVER w) AS s3 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
        m AS (SELECT user_id, quantile_cont(s1, 0.5) AS m1, quantile_cont(s2, 0.5) AS m2, quantile_cont(s3, 0.5) AS m3 FROM s GROUP BY user_id),
        d AS (SELECT user_id, quantile_cont(abs(s1 - m1), 0.5) AS d1, quantile_cont(abs(s2 - m2), 0.5) AS d2, quantile_cont(abs(s3 - m3), 0.5) AS d3 FROM s JOIN m USING (user_id) GROUP BY user_id),
        z AS (SELECT user_id, i, coalesce(abs(0.6745 * (s1 - m1) / d1) > 3.5, false) OR coalesce(abs(0.6745 * (s2 - m2) / d2) > 3.5, false) OR coalesce(abs(0.6745 * (s3 - m3) / d3) > 3.5, false) AS odd
        FROM s JOIN m USING (user_id) JOIN d USING (user_id))
        SELECT user_id, CASE WHEN count(*) >= 4 THEN round(1 - avg(CAST(odd AS DOUBLE)) FILTER (i > 1), 6) END AS anomaly_quality FROM z GROUP BY user_id""",
    "joint_noise": f"""WITH {E_SQL}, s AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS c, value - 2 * lag(value) OVER w + lag(value, 2) OVER w AS d2
        FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
        SELECT user_id, CASE WHEN count(*) < 4 THEN NULL WHEN sum(c * c) <= 1e-12 THEN 1.0 ELSE round(1 - sum(d2 * d2) / (sum(d2 * d2) + sum(c * c)), 6) END AS noise_quality FROM s GROUP BY user_id""",
    "joint_coordination": """WITH c AS (SELECT l_suppkey, unnest([CASE WHEN stddev_pop(l_quantity) > 1e-12 AND stddev_pop(l_extendedprice) > 1e-12 THEN abs(corr(l_quantity, l_extendedprice)) END,
        CASE WHEN stddev_pop(l_quantity) > 1e-12 AND stddev_pop(l_discount) > 1e-12 THEN abs(corr(l_quantity, l_discount)) END, CASE WHEN stddev_pop(l_quantity) > 1e-12 AND stddev_pop(l_tax) > 1e-12 THEN abs(corr(l_quantity, l_tax)) END,
        CASE WHEN stddev_pop(l_extendedprice) > 1e-12 AND stddev_pop(l_discount) > 1e-12 THEN abs(corr(l_extendedprice, l_discount)) END, CASE WHEN stddev_pop(l_extendedprice) > 1e-12 AND stddev_pop(l_tax) > 1e-12 THEN abs(corr(l_extendedprice, l_tax)) END,
        CASE WHEN stddev_pop(l_discount) > 1e-12 AND stddev_pop(l_tax) > 1e-12 THEN abs(corr(l_discount, l_tax)) END]) AS c FROM lineitem GROUP BY l_suppkey)
        SELECT l_suppkey, round(avg(c), 6) AS coordination FROM c GROUP BY l_suppkey""",
    "quantile_nmi": f"""WITH {E_SQL}, g AS (SELECT user_id % 10 AS g, value, us FROM e), q AS (SELECT g, list_distinct(quantile_cont(value, [0.2, 0.4, 0.6, 0.8])) AS qv, list_distinct(quantile_cont(CAST(us AS DOUBLE), [0.2, 0.4, 0.6, 0.8])) AS qu FROM g GROUP BY g),
        b AS (SELECT g, len(list_filter(qv, lambda x: value >= x)) AS a, len(list_filter(qu, lambda x: us >= x)) AS b FROM g JOIN q USING (g)),
        n AS (SELECT g, a, b, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY g, a) AS na, sum(n) OVER (PARTITION BY g, b) AS nb, sum(n) OVER (PARTITION BY g) AS t FROM n),
        i AS (SELECT g, sum(n / t * ln((n / t) / (na / t * nb / t))) AS mi, sum(-na / t * ln(na / t) * n / na) AS ha, sum(-nb / t * ln(nb / t) * n / nb) AS hb FROM t GROUP BY g)
        SELECT g, round(greatest(0, least(1, mi / ((ha + hb) / 2))), 6) AS nmi FROM i""",
}
