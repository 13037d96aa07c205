"""Registered queries of the relational, scoring, model and causal operators, with their SQL twins."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.functions import columns as C
from kinetrail.operators import causal, models
from kinetrail.operators import curation as U
from kinetrail.operators import effects as E
from kinetrail.operators import labels as L
from kinetrail.operators import matching as M
from kinetrail.operators import quality as Q
from kinetrail.operators import ranking as R
from kinetrail.operators import reports as V
from kinetrail.operators import scoring as S
from kinetrail.operators import signals as G
from kinetrail.operators import timeseries as T
from kinetrail.operators.order import group_quantiles as group_quantiles_of
from kinetrail.sources import records as rec
from kinetrail.sources.store import scratch
from kinetrail.plans.motion_queries import BY, E_SQL, ORDER, events, rounded, table

# --- Labels, completeness, metadata ---------------------------------------------------------------------------------


def final_label(spark, sf_dir):
    """Automatic label: the document has 100 characters; manual label: quality."""
    auto = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 100).cast("int").alias("auto_label"))
    found = L.merge_manual(auto, table(spark, sf_dir, "labels"), "doc_id", "quality")
    return found.select("doc_id", "auto_label", "manual_label", "final_label")


def review_queue(spark, sf_dir):
    auto = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") >= 100).cast("int").alias("auto_label"))
    return L.review_queue(auto).select("doc_id", "auto_label", "manual_label", "review_note")


def completeness(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("source", F.when(F.col("doc_id") % 3 != 0, F.col("source")).otherwise(F.lit("  ")))
    return rounded(docs.select("doc_id", C.share_present("lang", "source", "text", "n_chars").alias("share")))


def metadata_completeness(spark, sf_dir):
    """C6 and C23 over documents that stand for trajectories; some of the fields have no column."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        F.col("doc_id").alias("trajectory_id"), F.col("lang").alias("scene_id"), F.col("source").alias("task_name"),
        F.when(F.col("doc_id") % 3 == 0, " ").otherwise("m").alias("manufacturer"), F.col("n_chars").alias("collection_duration_in_ms"), F.when(F.col("doc_id") % 2 == 0, "o").alias("owner"),
    )
    rows = Q.attribute_completeness(Q.attribute_completeness(rows), Q.DESCRIPTION_FIELDS, "C23")
    return rounded(rows.select("trajectory_id", "C6", "C23"))


def visual_completeness(spark, sf_dir):
    """C3 with event types for cameras and one frame in six hours."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", T.micros("ts").alias("us"))
    span = rows.groupBy("user_id").agg(((F.max("us") - F.min("us")) / 1e6).alias("d"))
    return rounded(Q.visual_completeness(rows.join(span, "user_id"), ["user_id"], "event_type", "d", 1 / 21600))


def depth_validity(spark, sf_dir):
    """C4 with a document's share of white space and of digits for hole ratios."""
    docs = table(spark, sf_dir, "documents")
    ratio = lambda p: F.when(F.char_length("text") > 0, F.regexp_count("text", F.lit(p)) / F.char_length("text"))
    return rounded(Q.depth_validity(docs.select("doc_id", ratio("[ ]").alias("a"), ratio("[0-9]").alias("b")), ["a", "b"]).select("doc_id", "C4"))


def joint_completeness(spark, sf_dir):
    """C5 with every seventh value missing and one sample in twelve hours."""
    rows = events(spark, sf_dir).withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    span = rows.groupBy("user_id").agg(((F.max("us") - F.min("us")) / 1e6).alias("d"))
    return rounded(Q.joint_completeness(rows.join(span, "user_id"), ["user_id"], "d", ["value"], 1 / 43200))


def visual_joint_information(spark, sf_dir):
    """C17 with event types for cameras."""
    return rounded(Q.visual_joint_information(_two_channels(spark, sf_dir), ["user_id"], "event_type", "value", "k"))


def joint_indicators(spark, sf_dir):
    """C8, C10 and C18 of suppliers' vectors, with lines for samples."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")).alias("i"), "l_quantity", "l_discount", "l_tax")
    long = rows.select("l_suppkey", "i", *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")]).unpivot(["l_suppkey", "i"], ["l_quantity", "l_discount", "l_tax"], "dim", "v")
    return rounded(Q.joint_indicators(long, ["l_suppkey"], "i", "dim", "v"), 5)


def json_metadata(spark, sf_dir):
    """A declared field of the embedded JSON, numeric where it can be read as a number."""
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", C.to_number(F.get_json_object("props", "$.k")).alias("k"), F.get_json_object("props", "$.missing").isNull().alias("no_field"))


def metadata_outline(spark, sf_dir):
    """The keys of nested JSON texts; every third has no note."""
    owner = F.struct(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("note"))
    rows = table(spark, sf_dir, "orders").select(F.to_json(F.struct(F.col("o_orderstatus").alias("status"), owner.alias("owner"), F.array("o_orderkey").alias("items"))).alias("metadata"))
    return rec.metadata_outline(rows)


def _joint():
    return F.concat(F.lit("j"), (F.col("l_suppkey") % 7).cast("string"))


def _records(spark, sf_dir):
    """Order lines as steps of recordings, an order a file: returned ones are actions, all others states."""
    rows = table(spark, sf_dir, "lineitem")
    none = F.lit(None)
    return rows.select(
        F.concat(F.lit("/raw/"), F.col("l_orderkey").cast("string"), F.lit(".h5")).alias("path"), F.when(F.col("l_returnflag") == "R", "action").otherwise("state").alias("part"), _joint().alias("name"),
        F.col("l_linenumber").cast("int").alias("i"), (F.col("l_partkey") * 1000).cast("long").alias("ts_ns"),
        F.array(F.col("l_quantity").cast("double"), F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_discount").cast("double"))).alias("position"),
        none.cast("array<double>").alias("velocity"), none.cast("binary").alias("bytes"), none.cast("array<int>").alias("shape"), none.cast("string").alias("text"),
    )


def recording_samples(spark, sf_dir):
    found = rec.samples_of(_records(spark, sf_dir), F.lit("S"))
    return found.select("trajectory_id", "kind", "group", "seq", "ts_ns", F.col("position")[0].alias("x"), F.round(F.col("position")[1], 6).alias("y"))


def recording_summaries(spark, sf_dir):
    """Names, widths and counts by file: suppliers dealt to seven joint groups, a camera a line status."""
    rows = table(spark, sf_dir, "lineitem")
    path = F.concat(F.lit("/raw/"), F.col("l_orderkey").cast("string"), F.lit(".h5")).alias("path")
    none = F.lit(None).cast("string").alias("text")
    kind = F.when(F.col("l_returnflag") == "R", "action").otherwise("state")
    groups = rows.groupBy(path, F.lit("group").alias("part"), F.concat_ws("/", kind, _joint()).alias("name")).agg(F.array(F.count("*").cast("int"), F.max("l_linenumber").cast("int")).alias("shape"))
    cameras = rows.groupBy(path, F.lit("camera").alias("part"), F.col("l_linestatus").alias("name")).agg(F.array(F.count("*").cast("int"), F.count_if(F.col("l_tax") > 0.04).cast("int")).alias("shape"))
    found = rec.recording_summary(groups.withColumn("text", none).union(cameras.withColumn("text", none)))
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0), lambda s, x: s + x)
    return found.select(
        "trajectory_id", F.array_join("action_groups", ",").alias("action_groups"), F.array_join("state_groups", ",").alias("state_groups"), F.array_join("camera_names", ",").alias("camera_names"),
        total("dims").alias("dims"), F.coalesce(F.col("camera_counts")["F_color_n"], F.lit(0)).alias("f_color_n"), total("camera_counts").alias("n_frames"),
    )


def frame_range(spark, sf_dir):
    """The second to fourth line of every order, as images of a recording."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("frame_idx"), F.col("l_partkey").alias("ts_ns"))
    return rec.frame_range(rows, 1, 3).select("l_orderkey", "image_name")


def path_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("../raw/./"), F.regexp_replace("url", "^https?://", ""))
    return rows.select("page_id", C.base_name("url").alias("base"), C.safe_path(path).alias("path"), C.sheet_name("url").alias("sheet"), C.is_uuid(F.md5("url")).alias("is_uuid"))


def category_entropy(spark, sf_dir):
    return rounded(S.category_entropy(table(spark, sf_dir, "events"), "event_type", ["user_id"]))


def object_diversity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rounded(docs.groupBy("lang").agg(((F.countDistinct("source") - 1) / F.greatest(F.count("*") - 1, F.lit(1))).alias("diversity")))


# --- Scores -----------------------------------------------------------------------------------------------------------

INDICATORS = ["C8_anomaly", "C10_noise", "C11_timestamps", "C12_scene_entropy", "C14_skill", "C18_coordination"]
DIMENSIONS = {"accuracy": ["C8_anomaly", "C10_noise"], "consistency": ["C11_timestamps", "C18_coordination"], "diversity": ["C12_scene_entropy", "C14_skill"]}


def _indicators(spark, sf_dir) -> DataFrame:
    # one row a trajectory; the steps that follow read it several times
    return scratch(rounded(Q.event_indicators(_two_channels(spark, sf_dir), BY, ORDER, "event_type", "value", "k"), 9), "indicators")


def _two_channels(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("user_id", "event_id", "event_type", T.micros("ts").alias("us"), "value", C.to_number(F.get_json_object("props", "$.k")).alias("k"))


def indicators(spark, sf_dir):
    return _indicators(spark, sf_dir)


def minmax_norm(spark, sf_dir):
    return rounded(S.minmax(_indicators(spark, sf_dir), dict.fromkeys(INDICATORS, 1)), 9)


def entropy_weights(spark, sf_dir):
    return rounded(S.entropy_weights(rounded(S.minmax(_indicators(spark, sf_dir), dict.fromkeys(INDICATORS, 1)), 9), INDICATORS))


def quality_scores(spark, sf_dir):
    """The flagship: indicators, scaling, entropy weights and composite scores in one plan."""
    norm = rounded(S.minmax(_indicators(spark, sf_dir), dict.fromkeys(INDICATORS, 1)), 9)
    return rounded(S.composite_scores(norm, ["user_id"], S.entropy_weights(norm, INDICATORS), DIMENSIONS), 5)


IND_SQL = f"""{E_SQL}, w AS (SELECT *, row_number() OVER w AS i, value - lag(value) OVER w AS d1, value - 2 * lag(value) OVER w + lag(value, 2) OVER w AS d2,
    value - 3 * lag(value) OVER w + 3 * lag(value, 2) OVER w - lag(value, 3) OVER w AS d3, value - avg(value) OVER (PARTITION BY user_id) AS c,
    us - lag(us) OVER w AS dt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
    m AS (SELECT user_id, quantile_cont(abs(d1), 0.5) AS m1, quantile_cont(abs(d2), 0.5) AS m2, quantile_cont(abs(d3), 0.5) AS m3, quantile_cont(CAST(dt AS DOUBLE), 0.5) FILTER (dt > 0) AS mt,
        quantile_cont(value, 0.333) AS qa, quantile_cont(value, 0.667) AS qb FROM w GROUP BY user_id),
    d AS (SELECT user_id, quantile_cont(abs(abs(d1) - m1), 0.5) AS a1, quantile_cont(abs(abs(d2) - m2), 0.5) AS a2, quantile_cont(abs(abs(d3) - m3), 0.5) AS a3 FROM w JOIN m USING (user_id) GROUP BY user_id),
    kv AS (SELECT user_id, value, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
    cc AS (SELECT user_id, CASE WHEN stddev_pop(value) > 1e-12 AND stddev_pop(k) > 1e-12 AND count(*) >= 3 THEN abs(covar_pop(value, k) / (stddev_pop(value) * stddev_pop(k))) END AS act FROM kv GROUP BY user_id),
    x AS (SELECT user_id, count(*) AS n, avg(CAST(coalesce(0.6745 * abs(abs(d1) - m1) / a1 > 3.5, false) OR coalesce(0.6745 * abs(abs(d2) - m2) / a2 > 3.5, false)
        OR coalesce(0.6745 * abs(abs(d3) - m3) / a3 > 3.5, false) AS DOUBLE)) FILTER (i > 1) AS odd, sum(d2 * d2) AS e2, sum(c * c) AS e,
        avg(CAST(dt > 0 AS DOUBLE)) AS up, avg(CAST(dt > 0 AND dt <= 3 * mt AS DOUBLE)) FILTER (dt IS NOT NULL) AS steady,
        avg(CAST(value <= qa AS DOUBLE)) AS r0, avg(CAST(value > qa AND value <= qb AS DOUBLE)) AS r1, avg(CAST(value > qb AS DOUBLE)) AS r2, any_value(act) AS act
        FROM w JOIN m USING (user_id) JOIN d USING (user_id) JOIN cc USING (user_id) GROUP BY user_id),
    t AS (SELECT user_id, count(*) AS k FROM e GROUP BY user_id, event_type), tt AS (SELECT user_id, sum(k) AS s, count(*) AS g FROM t GROUP BY user_id),
    h AS (SELECT user_id, sum(-(k / s) * ln(k / s + 1e-12)) / ln(greatest(max(g), 2)) AS h FROM t JOIN tt USING (user_id) GROUP BY user_id),
    ind AS (SELECT user_id, round(1 - odd, 9) AS "C8_anomaly", round(1 - e2 / (e2 + e), 9) AS "C10_noise", round((up + steady) / 2, 9) AS "C11_timestamps", round(h, 9) AS "C12_scene_entropy",
        round(-(r0 * ln(r0) + r1 * ln(r1) + r2 * ln(r2)) / ln(3), 9) AS "C14_skill", round(act, 9) AS "C18_coordination" FROM x JOIN h USING (user_id)),
    lim AS (SELECT {", ".join(f'min("{c}") AS lo{i}, max("{c}") AS hi{i}' for i, c in enumerate(INDICATORS))} FROM ind),
    norm AS (SELECT user_id, {", ".join(f'''round(CASE WHEN hi{i} - lo{i} <= 1e-12 THEN 1.0 ELSE ("{c}" - lo{i}) / (hi{i} - lo{i}) END, 9) AS "{c}"''' for i, c in enumerate(INDICATORS))} FROM ind, lim),
    long AS (UNPIVOT norm ON {", ".join(f'"{c}"' for c in INDICATORS)} INTO NAME indicator VALUE x),
    sums AS (SELECT indicator, sum(x) AS s, count(*) AS n FROM long GROUP BY indicator),
    ent AS (SELECT indicator, -1 / ln(greatest(max(n), 2)) * sum(x / s * ln(x / s + 1e-12)) AS entropy FROM long JOIN sums USING (indicator) GROUP BY indicator),
    wt AS (SELECT indicator, (1 - entropy) / sum(1 - entropy) OVER () AS weight, entropy, 1 - entropy AS divergence FROM ent)"""


def spearman_corr(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("n_orders"), F.avg("o_totalprice").alias("avg_price"), F.min("o_orderkey").cast("double").alias("first_key"))
    rows = table(spark, sf_dir, "customer").join(per, "c_custkey").select("n_orders", "avg_price", "first_key", "c_acctbal")
    found = S.correlations(rows, ["n_orders", "avg_price", "first_key"], "c_acctbal")
    return rounded(found.withColumn("p_value", S.spearman_p("spearman", "n")), 5)


def zscore_hybrid(spark, sf_dir):
    df = U.customer_scores(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"))
    return rounded(U.hybrid_scores(df, "Q_score", "Q_accuracy", "Q_consistency", "delta").drop("scene_id"), 5)


SCORES_SQL = """s AS (SELECT c_custkey AS global_id, c_mktsegment AS scene_id, c_acctbal AS "Q_score", coalesce(avg(o_totalprice), 0) AS "Q_accuracy", CAST(count(o_orderkey) AS DOUBLE) AS "Q_consistency"
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL), sc AS (SELECT scene_id, avg("Q_accuracy") AS delta FROM s GROUP BY scene_id), base AS (SELECT s.*, delta FROM s JOIN sc USING (scene_id))"""


def unit_scale(spark, sf_dir):
    return rounded(S.unit_scale(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "scaled"))


def value_tiers(spark, sf_dir):
    nations = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("value"))
    return S.value_tiers(rounded(nations, 9), "value").select("c_nationkey", "tier")


def duplicate_uniqueness(spark, sf_dir):
    """Distance of each z-scored vector to its nearest other one, over the largest such distance."""
    return rounded(Q.uniqueness(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), 5)


def low_variance_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")], F.lit(1.0).alias("one"), F.when(F.col("l_orderkey") < 0, 1.0).alias("none"))
    return rounded(S.low_variance(rows, ["l_quantity", "l_discount", "l_tax", "l_linenumber", "one", "none"]))


# --- Aggregates, joins, sets ---------------------------------------------------------------------------------------------


def scene_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("scene_id"), F.col("c_acctbal").alias("Q_score"))
    return rounded(U.group_profile(rows, ["scene_id"], ["Q_score"]))


def delta_stability(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("scene_id"), (F.col("o_orderkey") % 3).alias("seed"), (F.col("o_totalprice") - 150000).alias("delta"))
    runs = rounded(rows.groupBy("scene_id", "seed").agg(F.avg("delta").alias("delta")), 4)
    return rounded(U.delta_stability(runs, ["scene_id"], "seed", "delta"), 4)


def marginal_value(spark, sf_dir):
    """Value of each scene to a mean predictor: error of the others' prediction with and without it."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("scene_id"), F.col("c_acctbal").alias("y"))
    return rounded(U.leave_one_out_value(rows, "scene_id", "y"), 5)


def train_mean_baseline(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("fold"), F.col("o_totalprice").alias("y"))
    return rounded(S.regression_metrics(models.mean_baseline(rows, "y", "fold"), ["fold"], "y", "pred").drop("pearson", "r2"), 4)


def master_table(spark, sf_dir):
    return rounded(U.master_table(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation")), 8)


def master_check(spark, sf_dir):
    rows = U.master_table(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation"))
    return U.integrity(rows, "c_custkey", ["avg_price", "n_name"])


def union_distinct(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority")
    b = o.where("o_orderstatus <> 'F'").select("o_orderpriority", "o_custkey", F.col("o_orderstatus").alias("status"))
    return U.stack([a, b]).dropDuplicates(["o_custkey", "o_orderpriority"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def pivot_means(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("status", F.col("o_orderstatus"))
    return rounded(rows.groupBy("o_orderpriority").pivot("status", ["F", "O", "P"]).avg("o_totalprice"), 4)


def grouped_heterogeneity(spark, sf_dir):
    """Means by group and for all, in one pass over rows that belong to both."""
    rows = table(spark, sf_dir, "customer").select("c_acctbal", F.explode(F.array(F.lit("all"), F.col("c_mktsegment"))).alias("grp"))
    return rounded(rows.groupBy("grp").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("mean")))


def dominant_values(spark, sf_dir):
    """The most frequent order status of each priority (ties: the smallest), with its share."""
    n = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    best = F.min_by("o_orderstatus", F.struct(-F.col("n"), F.col("o_orderstatus")))
    return rounded(n.groupBy("o_orderpriority").agg(best.alias("mode"), (F.max("n") / F.sum("n")).alias("share")))


def histogram(spark, sf_dir):
    """Four equal bins of quantity as shares (a value's bin by floor division)."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.least(F.floor((F.col("l_quantity") - 1) / 12.5), F.lit(3)).alias("bin"))
    n = rows.groupBy("l_returnflag", "bin").agg(F.count("*").alias("n"))
    t = n.groupBy("l_returnflag").agg(F.sum("n").alias("t"))
    return rounded(n.join(t, "l_returnflag").select("l_returnflag", "bin", (F.col("n") / F.col("t")).alias("share")))


# --- Selections and curation ------------------------------------------------------------------------------------------------


def _pool(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("global_id"), F.col("c_mktsegment").alias("scene_id"), F.col("c_acctbal").alias("score"))


def select_top(spark, sf_dir):
    return R.top_n(_pool(spark, sf_dir), "score", "global_id", 40).select("global_id", F.col("selected_rank").cast("long").alias("selected_rank"))


def select_low(spark, sf_dir):
    return R.top_n(_pool(spark, sf_dir), "score", "global_id", 40, largest=False).select("global_id", F.col("selected_rank").cast("long").alias("selected_rank"))


def select_stratified(spark, sf_dir):
    return R.top_share_per_group(_pool(spark, sf_dir), "scene_id", "score", "global_id", 0.15).select("global_id", "scene_id")


def select_random(spark, sf_dir):
    return R.random_n(_pool(spark, sf_dir), "global_id", 100, 7).select("global_id")


def split_train_val(spark, sf_dir):
    return R.split_train(_pool(spark, sf_dir), "scene_id", "global_id", 0.8).select("global_id", "split")


def split_test_pool(spark, sf_dir):
    return R.split_test_pool(_pool(spark, sf_dir), "scene_id", "global_id", 0.2).select("global_id", "split")


def k_folds(spark, sf_dir):
    return R.k_folds(_pool(spark, sf_dir), "scene_id", "global_id", 5).select("global_id", "fold")


def curation_curve(spark, sf_dir):
    df = _pool(spark, sf_dir).withColumn("value", F.col("score") * (F.col("global_id") % 7))
    return rounded(R.curation_curve(df, "score", "value", "global_id", [0.1, 0.3, 0.5, 1.0], "scene_id"), 4)


def min_ratio(spark, sf_dir):
    df = _pool(spark, sf_dir).withColumn("value", F.col("score") * (F.col("global_id") % 7))
    return R.least_ratio(R.curation_curve(df, "score", "value", "global_id", [0.1, 0.3, 0.5, 1.0], "scene_id"), "scene_id")


def cumulative_value(spark, sf_dir):
    scenes = rounded(_pool(spark, sf_dir).groupBy("scene_id").agg(F.avg("score").alias("value")), 9)
    return rounded(R.cumulative_mean(scenes, "value", "scene_id", False).select("scene_id", F.col("position").cast("long").alias("position"), "cum_mean"))


def pending_jobs(spark, sf_dir):
    """Jobs of the grid that no stored result names."""
    grid = U.job_grid(spark, ["full", "high_Q_global", "random"], [0.2, 0.5, 1.0], [0, 1], [0, 1, 2])
    done = grid.where("strategy = 'random' AND ratio = 0.5 OR run_seed = 1")
    return U.pending(grid, done).select("strategy", F.col("ratio").cast("double").alias("ratio"), "run_seed")


def curation_summary(spark, sf_dir):
    """Count, mean and std of a proxy metric by strategy and ratio, with gains against full and random."""
    df = U.customer_scores(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"))
    runs = U.proxy_runs(df, ["high", "low", "full"], [0.2, 0.5], 3)
    return rounded(U.curation_summary(runs, "metric", "full"), 4)


def rank_desc(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max("p_size").alias("v"))
    return V.rank_desc(rows, "v").select("p_brand", "v", "rank")


def boxplot(spark, sf_dir):
    return rounded(V.boxplot(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"), 4)


def radar_extremes(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("score"))
    return V.extremes(rounded(rows, 9), "score", "s_nationkey", 5).select("s_nationkey", "side")


def robustness_rollup(spark, sf_dir):
    e = _effect_table(spark, sf_dir)
    return rounded(V.robustness(e, ["grp", "outcome"], "threshold", "att"), 4)


def _effect_table(spark, sf_dir):
    """Naive effects: mean difference over and under two balance quantiles, for groups and all, two outcomes."""
    df = U.customer_scores(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"))
    df = causal.treatments(df, ["Q_score"], [0.5, 0.6])
    rows = df.withColumn("grp", F.explode(F.array(F.lit("all"), F.col("scene_id"))))
    long = rows.unpivot(["grp", "t_Q_score_q50", "t_Q_score_q60"], ["Q_accuracy", "Q_consistency"], "outcome", "y").unpivot(["grp", "outcome", "y"], ["t_Q_score_q50", "t_Q_score_q60"], "treatment", "t")
    att = F.avg(F.when(F.col("t") == 1, F.col("y"))) - F.avg(F.when(F.col("t") == 0, F.col("y")))
    return long.groupBy("grp", "outcome", "treatment").agg(att.alias("att")).withColumn("threshold", C.quantile_suffix("treatment"))


def treatments(spark, sf_dir):
    return causal.treatments(_pool(spark, sf_dir), ["score"], [0.5, 0.6]).select("global_id", "t_score_q50", "t_score_q60")


def balance_smd(spark, sf_dir):
    df = causal.treatments(U.customer_scores(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")), ["Q_score"], [0.5])
    return rounded(causal.balance(df, ["Q_accuracy", "Q_consistency"], "t_Q_score_q50"), 5)


def _held_out_errors(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    errors = {"mse": F.col("l_discount"), "mae": F.col("l_tax"), "nmse": F.col("l_quantity") / 50}
    return lines.select(F.col("l_orderkey").alias("global_id"), (F.col("l_orderkey") % 5).alias("scene_id"), *[e.cast("double").alias(n) for n, e in errors.items()])


def trajectory_errors(spark, sf_dir):
    return rounded(L.trajectory_errors(_held_out_errors(spark, sf_dir), "global_id", "scene_id", "mse", "mae", "nmse"), 6)


def label_summary(spark, sf_dir):
    return rounded(L.label_summary(L.trajectory_errors(_held_out_errors(spark, sf_dir), "global_id", "scene_id", "mse", "mae", "nmse"), "scene_id"), 6)


def balance_brief(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    smd = {"abs_smd_before": F.col("p_size") / 100, "abs_smd_after": F.col("p_size") / 200}
    found = parts.select(F.col("p_brand").alias("treatment"), F.col("p_name").alias("covariate"), *[e.cast("double").alias(n) for n, e in smd.items()])
    return rounded(causal.balance_brief(found, ["treatment"]), 6)


def dual_scores(spark, sf_dir):
    """Two balances' even mix, with segments mapped to groups."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("global_id"), F.col("c_acctbal").cast("double").alias("a"), F.col("c_nationkey").cast("double").alias("b"), "c_mktsegment")
    group = C.mapped("c_mktsegment", {"BUILDING": "fixed", "MACHINERY": "fixed", "AUTOMOBILE": "moving"}, "other")
    return rounded(rows.select("global_id", S.dual_score("a", "b").alias("dual_score"), group.alias("task_group")), 6)


def value_with_labels(spark, sf_dir):
    """Orders' values joined to customers' labels on the keys that both sides have."""
    values = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("global_id")).agg(F.count("*").alias("n_orders"))
    labels = _pool(spark, sf_dir).withColumn("final_label", (F.col("score") > 0).cast("int")).select("global_id", "scene_id", "final_label")
    return U.joined_on_shared(values, labels, [["scene_id", "global_id"], ["global_id"]]).select("global_id", "scene_id", "n_orders", "final_label")


def group_value_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("global_id"), F.col("c_mktsegment").alias("scene_id"), F.col("c_acctbal").cast("double").alias("value"), "c_nationkey")
    return rounded(U.value_summary(rows, ["scene_id"], "global_id", ["value"], ["c_nationkey"]), 4)


def random_baseline(spark, sf_dir):
    return rounded(R.random_curve(_pool(spark, sf_dir), "score", "global_id", [0.1, 0.5, 1.0], 20), 4)


def folds_of_all(spark, sf_dir):
    return R.k_folds(_pool(spark, sf_dir), None, "global_id", 7).select("global_id", "fold")


def cumulative_of_all(spark, sf_dir):
    """Balances in cents, so that sums are exact in any order of slices."""
    rows = _pool(spark, sf_dir).withColumn("cents", F.round(F.col("score") * 100).cast("long"))
    return R.cumulative_mean(rows, "cents", "global_id", True).select("global_id", F.col("position").cast("long").alias("position"), "cum_mean")


def scatter_points(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), (F.col("p_partkey") % 10).alias("value"))
    return rounded(V.scatter(rows, "p_partkey", ["size", "price"], "value"), 4)


def ordered_messages(spark, sf_dir):
    return V.first_seen(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_orderkey")


def depth_features(spark, sf_dir):
    """Vectors stand for depth frames: components up to 0 are holes."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", C.depth_stats("embedding").alias("d"))
    return rounded(rows.select("vec_id", "d.mean", "d.std", "d.hole_ratio"), 5)


def confounder_choice(spark, sf_dir):
    """Of names of columns, those that can serve as confounders."""
    rows = table(spark, sf_dir, "customer").withColumn("never", F.lit(None).cast("double"))
    names = causal.confounders(rows, ["c_acctbal", "c_name", "never", "c_nationkey", "absent"])
    return spark.createDataFrame([(n,) for n in names], "covariate string")


# --- Models (rows only: no SQL twin) ---------------------------------------------------------------------------------------


def ridge_loocv(spark, sf_dir):
    df = U.customer_scores(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"))
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("global_id"), "c_nationkey")
    per = df.join(nation, "global_id").groupBy("c_nationkey").agg(F.count("*").cast("double").alias("n"), F.avg("Q_score").alias("q"), F.avg("Q_consistency").alias("k"), F.avg("Q_accuracy").alias("y"))
    return models.ridge_folds(per, ["n", "q", "k"], "y", "c_nationkey").select("c_nationkey", "y", "pred")


def feature_importance(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(*[F.col(x).cast("double") for x in ("p_size", "p_retailprice")], (F.col("p_partkey") % 13).cast("double").alias("m"))
    return models.importance(rows, ["p_size", "m"], "p_retailprice")


def _matched(spark, sf_dir):
    df = causal.treatments(U.customer_scores(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")), ["Q_score"], [0.6])
    p = models.propensity(df, ["Q_consistency", "delta"], "t_Q_score_q60")
    return df, M.closest_pairs(p, "scene_id", "global_id", "t_Q_score_q60")


def propensity_matches(spark, sf_dir):
    return _matched(spark, sf_dir)[1]


def matched_effects(spark, sf_dir):
    df, pairs = _matched(spark, sf_dir)
    return M.bootstrap_effects(causal.pair_outcomes(pairs, df, "global_id", ["Q_accuracy", "Q_consistency"]), ["outcome"])


def effect_cells(spark, sf_dir):
    """Three treatments, all scenes and two groups of them, and two outcomes, one of which is better when lower."""
    scores = U.customer_scores(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")).withColumn("size", (F.col("global_id") % 17).cast("double"))
    df = scratch(causal.treatments(scores, ["Q_score", "Q_consistency"], [0.5, 0.6]), "effect-rows")
    treated = {f"t_{c}_q{q}": c for c, q in (("Q_score", 50), ("Q_score", 60), ("Q_consistency", 50))}
    groups = {"all": None, "goods": ["AUTOMOBILE", "MACHINERY", "FURNITURE"], "homes": ["BUILDING", "HOUSEHOLD"]}
    return E.estimate(df, "global_id", "scene_id", treated, ["Q_consistency", "delta", "size"], {"Q_accuracy": 1, "Q_score": -1}, groups).effects


def bootstrap_intervals(spark, sf_dir):
    """Mean distance of order prices from a target, with Poisson bootstrap intervals, by priority."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice").cast("double") - 150000).alias("diff"))
    return rounded(M.bootstrap_effects(rows, ["o_orderpriority"], "o_orderkey", "diff", n_boot=100), 4)


def group_quantiles(spark, sf_dir):
    """Exact quantiles of prices by return flag and line status; groups of over 2,000 values go by brackets."""
    found = group_quantiles_of(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.1, 0.5, 0.95], most=2000)
    return rounded(found.select("l_returnflag", "l_linestatus", *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q10", "q50", "q95"))]), 4)


def vector_event_signals(spark, sf_dir):
    """Event signals of four channels a supplier, with gaps; the largest figures of each of its orders are a frame."""
    values = [("l_quantity", 50), ("l_discount", 0.1), ("l_tax", 0.1), ("l_extendedprice", 100000)]
    frames = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_orderkey").alias("k")).agg(*[F.max(F.col(c).cast("double")).alias(c) for c, _ in values])
    cells = F.array(*[F.struct(F.lit(i).alias("dim"), F.when((F.col("k") + i) % 13 != 0, F.col(c) / w).alias("v")) for i, (c, w) in enumerate(values)])
    rows = frames.select("l_suppkey", "k", F.inline(cells))
    return rounded(G.vector_signals(rows, ["l_suppkey"], "k", "dim", "v"))


SELECTION_JOBS = [("full", 1.0, 0), ("random", 0.3, 5), ("high_Q_global", 0.2, 0), ("high_Q_global", 0.5, 0), ("low_Q_score", 0.2, 0), ("high_Q_stratified", 0.2, 0), ("high_delta", 0.5, 0)]


def selection_grid(spark, sf_dir):
    """Selections of seven jobs, marked on the pool in one plan."""
    pool = _pool(spark, sf_dir).select("global_id", "scene_id", F.col("score").alias("Q_score"), (F.col("global_id") % 97).cast("double").alias("delta"))
    return U.mark_selections(pool, SELECTION_JOBS).select("global_id", F.inline("picks"))


def evaluation_summary(spark, sf_dir):
    """Runs by priority and size class stand for a grid's metrics."""
    o = table(spark, sf_dir, "orders")
    strategy = F.when(F.col("o_orderkey") % 4 == 0, "random").when(F.col("o_orderkey") % 4 == 1, "full").otherwise(F.lower(F.substring("o_orderpriority", 3, 20)))
    runs = o.withColumns({"strategy": strategy, "ratio": F.when(strategy == "full", 1.0).otherwise(F.round((F.col("o_orderkey") % 3 + 1) / 4.0, 4)), "run_seed": F.col("o_custkey") % 5})
    runs = runs.groupBy("strategy", "ratio", "run_seed").agg((F.avg("o_totalprice").cast("double") / 100000).alias("test_nmse"))
    return rounded(U.evaluation_summary(runs.withColumn("test_imitation_score", F.exp(-F.col("test_nmse")))))


def prediction_metrics(spark, sf_dir):
    """Errors, fit and rank correlation of a crude prediction with many ties, by priority."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").cast("double").alias("y"), (F.col("o_custkey") % 50 * 6000.0).alias("p"))
    return rounded(S.prediction_metrics(rows, ["o_orderpriority"], "y", "p"), 4)


def cv_summary(spark, sf_dir):
    """A mean predictor's errors, summed up over folds."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_orderpriority").alias("fold"), F.col("o_totalprice").cast("double").alias("y"))
    metrics = S.regression_metrics(models.mean_baseline(rows, "y", "fold"), ["o_orderstatus", "fold"], "y", "pred")
    return rounded(S.fold_summary(metrics, ["o_orderstatus"], "fold", ["mae", "rmse", "r2"]), 4)


def seeded_splits(spark, sf_dir):
    """Test split, training split and folds of one pool in seeded random order."""
    pool = _pool(spark, sf_dir).select("global_id", "scene_id")
    test = R.split_test_pool(pool, "scene_id", "global_id", 0.2, 42).withColumnRenamed("split", "test_split")
    train = R.split_train(test, "scene_id", "global_id", 0.8, 7).withColumnRenamed("split", "train_split")
    return R.k_folds(train, "scene_id", "global_id", 5, 3).select("global_id", "test_split", "train_split", "fold")


def workbook_sheets(spark, sf_dir):
    """Sheet names of pages by the first 20 characters of their address, repeats told apart."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.substring("url", 1, 20).alias("u"))
    return C.unique_sheet_names(rows, "u", "page_id").select("page_id", "sheet")


def _vectors(spark, sf_dir, k: int = 64):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(k)])


def pca_robustness(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return Q.pca_robustness(rows.withColumn("Q_score", F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)), "embedding", "Q_score")


def motion_modes(spark, sf_dir):
    """Rarity of each row's k-means cluster."""
    return Q.mode_rarity(_vectors(spark, sf_dir), [f"x{i}" for i in range(64)], "vec_id", 42).select("vec_id", "cluster", "rarity")


def bc_job_grid(spark, sf_dir):
    """Base and leave-one-scene-out networks over windows of events, and each scene's marginal value."""
    rows = events(spark, sf_dir)
    windows = T.sliding_windows(rows, BY, ORDER, ["value"], ["value"], 5, 2).join(rows.select("user_id").distinct(), "user_id")
    scene = F.concat(F.lit("S"), F.col("user_id") % 4 + 1)
    samples = windows.select(F.concat_ws("_", scene, "user_id", "i").alias("sample_id"), scene.alias("scene_id"), "x", "y", (F.xxhash64("user_id") % 5 == 0).alias("is_val"))
    return U.scene_values(samples, ["S1", "S2", "S3", "S4"], seeds=[0, 1, 2])


QUERIES = {
    f.__name__: f
    for f in (
        final_label, review_queue, completeness, metadata_completeness, visual_completeness, depth_validity, joint_completeness, visual_joint_information, joint_indicators, json_metadata, path_functions, category_entropy, object_diversity, indicators, minmax_norm, entropy_weights, quality_scores,
        spearman_corr, zscore_hybrid, unit_scale, value_tiers, duplicate_uniqueness, low_variance_filter, scene_profile, delta_stability, marginal_value, train_mean_baseline,
        master_table, master_check, union_distinct, pivot_means, grouped_heterogeneity, dominant_values, histogram, select_top, select_low, select_stratified, select_random,
        split_train_val, split_test_pool, k_folds, curation_curve, min_ratio, cumulative_value, pending_jobs, curation_summary, rank_desc, boxplot, radar_extremes,
        robustness_rollup, treatments, balance_smd, balance_brief, trajectory_errors, label_summary, dual_scores, value_with_labels, group_value_summary, random_baseline, folds_of_all, cumulative_of_all, scatter_points,
        ordered_messages, depth_features, confounder_choice, feature_importance, ridge_loocv, propensity_matches, matched_effects, pca_robustness, motion_modes, bc_job_grid,
        effect_cells, bootstrap_intervals, group_quantiles, vector_event_signals, selection_grid, evaluation_summary, prediction_metrics, cv_summary, seeded_splits, workbook_sheets,
        metadata_outline, recording_samples, recording_summaries, frame_range,
    )
}

_AUTO_SQL = "a AS (SELECT doc_id, CASE WHEN n_chars >= 100 THEN 1 ELSE 0 END AS auto_label FROM documents)"
_ERRORS_SQL = """e AS (SELECT l_orderkey AS global_id, min(l_orderkey % 5) AS scene_id, avg(CAST(l_discount AS DOUBLE)) AS mse, avg(CAST(l_tax AS DOUBLE)) AS mae,
    avg(CAST(l_quantity AS DOUBLE) / 50) AS nmse, count(*) AS n_bc_windows FROM lineitem GROUP BY l_orderkey)"""
_POISSON = str([sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(12)])
_POOL_SQL = "p AS (SELECT c_custkey AS global_id, c_mktsegment AS scene_id, c_acctbal AS score FROM customer)"
_CURVE_SQL = f"""{_POOL_SQL}, r AS (SELECT *, score * (global_id % 7) AS value, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC, global_id) AS rn, count(*) OVER (PARTITION BY scene_id) AS cnt FROM p),
    x AS (SELECT *, CAST(unnest([0.1, 0.3, 0.5, 1.0]) AS DOUBLE) AS ratio FROM r), c AS (SELECT scene_id, ratio, count(*) AS n, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS stderr
    FROM x WHERE rn <= greatest(1, ceil(ratio * cnt)) GROUP BY ALL)"""
_MASTER_SQL = """m AS (SELECT c_custkey, c_nationkey, c_acctbal, n_orders, avg_price, n_name FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS avg_price FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey)"""
_Z = lambda c: f'(("{c}" - avg("{c}") OVER ()) / stddev_pop("{c}") OVER ())'
_EFFECT_SQL = f"""{SCORES_SQL}, q AS (SELECT quantile_cont("Q_score", 0.5) AS q50, quantile_cont("Q_score", 0.6) AS q60 FROM base),
    r AS (SELECT unnest(['all', scene_id]) AS grp, "Q_accuracy" AS a, "Q_consistency" AS k, CAST("Q_score" >= q50 AS INT) AS t50, CAST("Q_score" >= q60 AS INT) AS t60 FROM base, q),
    l AS (SELECT grp, 'Q_accuracy' AS outcome, a AS y, t50, t60 FROM r UNION ALL SELECT grp, 'Q_consistency', k, t50, t60 FROM r),
    f AS (SELECT grp, outcome, 50 AS threshold, avg(y) FILTER (t50 = 1) - avg(y) FILTER (t50 = 0) AS att FROM l GROUP BY ALL UNION ALL
          SELECT grp, outcome, 60, avg(y) FILTER (t60 = 1) - avg(y) FILTER (t60 = 0) FROM l GROUP BY ALL)"""


def _rank_sql(x: str, y: str) -> str:
    r = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return f"""SELECT '{x}' AS feature, count(*) AS n, round(corr({x}, {y}), 5) AS pearson, corr(rx, ry) AS rho FROM (SELECT {x}, {y}, CAST({r(x)} AS DOUBLE) AS rx, CAST({r(y)} AS DOUBLE) AS ry FROM j)"""


_TAIL = "abs(least(0.999999, greatest(-0.999999, rho)) * sqrt((n - 2) / (1 - rho * rho))) / sqrt(2)"
_ERFC = " + ".join(f"{a} * pow(1 / (1 + 0.3275911 * x), {i})" for i, a in enumerate((0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429), 1))

ORACLE_SQL = {
    "final_label": f"WITH {_AUTO_SQL} SELECT a.doc_id, auto_label, quality AS manual_label, coalesce(quality, auto_label) AS final_label FROM a LEFT JOIN labels USING (doc_id)",
    "review_queue": f"WITH {_AUTO_SQL} SELECT doc_id, auto_label, CAST(NULL AS INT) AS manual_label, '' AS review_note FROM a WHERE auto_label = 0",
    "completeness": """SELECT doc_id, round((CAST(trim(coalesce(lang, '')) <> '' AS INT) + CASE WHEN doc_id % 3 <> 0 AND trim(coalesce(source, '')) <> '' THEN 1 ELSE 0 END
        + CAST(trim(coalesce(text, '')) <> '' AS INT) + CAST(n_chars IS NOT NULL AS INT)) / 4.0, 6) AS share FROM documents""",
    "metadata_completeness": """WITH f AS (SELECT *, CAST(trim(coalesce(lang, '')) <> '' AS INT) + CAST(trim(coalesce(source, '')) <> '' AS INT) + CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END AS n_both FROM documents)
        SELECT doc_id AS trajectory_id, round((n_both + 1 + CAST(n_chars IS NOT NULL AS INT)) / 8.0, 6) AS "C6", round((n_both + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END) / 9.0, 6) AS "C23" FROM f""",
    "visual_completeness": """WITH s AS (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS d FROM events GROUP BY user_id),
        n AS (SELECT user_id, event_type, least(1.0, count(*) / greatest(1.0, any_value(d) / 21600)) AS r FROM events JOIN s USING (user_id) GROUP BY user_id, event_type)
        SELECT user_id, round(avg(r), 6) AS "C3" FROM n GROUP BY user_id""",
    "depth_validity": """WITH r AS (SELECT doc_id, [CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[ ]')) / length(text) END, CASE WHEN length(text) > 0 THEN len(regexp_extract_all(text, '[0-9]')) / length(text) END] AS h FROM documents)
        SELECT doc_id, round(greatest(0, least(1, 1 - list_avg(h))), 6) AS "C4" FROM r""",
    "joint_completeness": """WITH e AS (SELECT user_id, epoch_us(ts) AS us, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events),
        a AS (SELECT user_id, count(*) AS n, floor((max(us) - min(us)) / 1e6 / 43200) + 1 AS full_n, avg(CAST(v IS NULL AS DOUBLE)) AS gap FROM e GROUP BY user_id)
        SELECT user_id, round((least(1.0, n / full_n) + 1 - gap) / 2, 6) AS "C5" FROM a""",
    "visual_joint_information": """WITH e AS (SELECT user_id, event_type, value AS x, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y FROM events), k AS (SELECT * FROM e WHERE x IS NOT NULL AND y IS NOT NULL),
        q AS (SELECT user_id, event_type, list_distinct(quantile_cont(x, [0.2, 0.4, 0.6, 0.8])) AS qx, list_distinct(quantile_cont(y, [0.2, 0.4, 0.6, 0.8])) AS qy FROM k GROUP BY ALL HAVING count(*) >= 5 AND stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12),
        b AS (SELECT user_id, event_type, len(list_filter(qx, lambda v: x >= v)) AS a, len(list_filter(qy, lambda v: y >= v)) AS b FROM k JOIN q USING (user_id, event_type)),
        n AS (SELECT user_id, event_type, a, b, count(*) AS n FROM b GROUP BY ALL),
        t AS (SELECT *, sum(n) OVER (PARTITION BY user_id, event_type, a) AS na, sum(n) OVER (PARTITION BY user_id, event_type, b) AS nb, sum(n) OVER (PARTITION BY user_id, event_type) AS t FROM n),
        i AS (SELECT user_id, event_type, sum(n / t * ln((n / t) / (na / t * nb / t))) AS mi, sum(-na / t * ln(na / t) * n / na) AS ha, sum(-nb / t * ln(nb / t) * n / nb) AS hb FROM t GROUP BY ALL)
        SELECT user_id, round(avg(CASE WHEN (ha + hb) / 2 > 1e-12 THEN greatest(0, least(1, mi / ((ha + hb) / 2))) ELSE 0 END), 6) AS "C17" FROM i GROUP BY user_id""",
    "joint_indicators": """WITH r AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS i, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b, CAST(l_tax AS DOUBLE) AS c FROM lineitem),
        l AS (UNPIVOT r ON a, b, c INTO NAME dim VALUE v),
        s AS (SELECT *, abs(v - lag(v) OVER w) AS s1, abs(v - 2 * lag(v) OVER w + lag(v, 2) OVER w) AS s2, abs(v - 3 * lag(v) OVER w + 3 * lag(v, 2) OVER w - lag(v, 3) OVER w) AS s3,
            v - avg(v) OVER (PARTITION BY l_suppkey, dim) AS c FROM l WINDOW w AS (PARTITION BY l_suppkey, dim ORDER BY i)),
        g AS (SELECT l_suppkey, i, avg(s1) AS s1, avg(s2) AS s2, avg(s3) AS s3, sum(c * c) AS e, sum(s2 * s2) AS e2 FROM s GROUP BY ALL),
        m AS (SELECT l_suppkey, quantile_cont(s1, 0.5) AS m1, quantile_cont(s2, 0.5) AS m2, quantile_cont(s3, 0.5) AS m3 FROM g GROUP BY l_suppkey),
        d AS (SELECT l_suppkey, quantile_cont(abs(s1 - m1), 0.5) AS d1, quantile_cont(abs(s2 - m2), 0.5) AS d2, quantile_cont(abs(s3 - m3), 0.5) AS d3 FROM g JOIN m USING (l_suppkey) GROUP BY l_suppkey),
        o AS (SELECT l_suppkey, count(*) AS n, avg(CAST(coalesce(0.6745 * abs(s1 - m1) / d1 > 3.5, false) OR coalesce(0.6745 * abs(s2 - m2) / d2 > 3.5, false) OR coalesce(0.6745 * abs(s3 - m3) / d3 > 3.5, false) AS DOUBLE)) FILTER (s1 IS NOT NULL) AS odd,
            sum(e) AS e, sum(e2) AS e2 FROM g JOIN m USING (l_suppkey) JOIN d USING (l_suppkey) GROUP BY l_suppkey),
        p AS (SELECT l_suppkey, list_avg([abs(corr(a, b)), abs(corr(a, c)), abs(corr(b, c))]) AS r FROM r GROUP BY l_suppkey)
        SELECT l_suppkey, CASE WHEN n >= 4 THEN round(1 - odd, 5) END AS "C8", CASE WHEN n >= 4 THEN round(1 - e2 / (e2 + e), 5) END AS "C10", round(r, 5) AS "C18" FROM o JOIN p USING (l_suppkey)""",
    "json_metadata": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, json_extract(props, '$.missing') IS NULL AS no_field FROM events",
    "metadata_outline": """SELECT 'status' AS path, 'string' AS kind, count(o_orderstatus) AS n, min(o_orderstatus) AS example FROM orders UNION ALL SELECT 'owner', 'object', count(*), NULL FROM orders
        UNION ALL SELECT 'owner.id', 'bigint', count(o_custkey), min(CAST(o_custkey AS VARCHAR)) FROM orders UNION ALL SELECT 'items', 'array', count(*), NULL FROM orders
        UNION ALL SELECT 'owner.note', 'string', count(o_orderpriority), min(o_orderpriority) FROM orders WHERE o_orderkey % 3 <> 0""",
    "recording_samples": """SELECT CAST(l_orderkey AS VARCHAR) AS trajectory_id, CASE WHEN l_returnflag = 'R' THEN 'action' ELSE 'state' END AS kind, 'j' || l_suppkey % 7 AS "group", CAST(l_linenumber AS INT) AS seq,
        CAST(l_partkey * 1000 AS BIGINT) AS ts_ns, CAST(l_quantity AS DOUBLE) AS x, CASE WHEN l_linenumber <> 1 THEN round(CAST(l_discount AS DOUBLE), 6) END AS y FROM lineitem""",
    "recording_summaries": """WITH l AS (SELECT *, 'j' || l_suppkey % 7 AS joint, CASE WHEN l_returnflag = 'R' THEN 'action' ELSE 'state' END AS kind FROM lineitem),
        d AS (SELECT l_orderkey, CAST(sum(w) AS INT) AS dims FROM (SELECT l_orderkey, max(l_linenumber) AS w FROM l GROUP BY l_orderkey, kind, joint) GROUP BY 1)
        SELECT CAST(l_orderkey AS VARCHAR) AS trajectory_id, coalesce(string_agg(DISTINCT joint, ',' ORDER BY joint) FILTER (kind = 'action'), '') AS action_groups,
        coalesce(string_agg(DISTINCT joint, ',' ORDER BY joint) FILTER (kind = 'state'), '') AS state_groups, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS camera_names,
        any_value(dims) AS dims, CAST(count(*) FILTER (l_linestatus = 'F') AS INT) AS f_color_n, CAST(count(*) + count(*) FILTER (l_tax > 0.04) AS INT) AS n_frames FROM l JOIN d USING (l_orderkey) GROUP BY l_orderkey""",
    "frame_range": "SELECT l_orderkey, printf('img_%06d_%d', CAST(l_linenumber - 1 AS BIGINT), CAST(l_partkey AS BIGINT)) AS image_name FROM lineitem WHERE l_linenumber BETWEEN 2 AND 4",
    "path_functions": r"""SELECT page_id, string_split(url, '/')[-1] AS base, array_to_string(list_filter(string_split('../raw/./' || regexp_replace(url, '^https?://', ''), '/'), lambda p: p NOT IN ('', '.', '..')), '/') AS path,
        left(trim(regexp_replace(url, '[\\/*?:\[\]]', '_', 'g')), 31) AS sheet, regexp_full_match(md5(url), '[0-9a-fA-F]{32}') AS is_uuid FROM pages""",
    "category_entropy": """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL), t AS (SELECT user_id, sum(n) AS t, count(*) AS k FROM c GROUP BY user_id)
        SELECT user_id, round(sum(-(n / t) * ln(n / t + 1e-12)) / ln(greatest(max(k), 2)), 6) AS entropy FROM c JOIN t USING (user_id) GROUP BY user_id""",
    "object_diversity": "SELECT lang, round((count(DISTINCT source) - 1) / greatest(count(*) - 1, 1), 6) AS diversity FROM documents GROUP BY lang",
    "indicators": f"WITH {IND_SQL} SELECT * FROM ind",
    "minmax_norm": f"WITH {IND_SQL} SELECT * FROM norm",
    "entropy_weights": f"WITH {IND_SQL} SELECT indicator, round(weight, 6) AS weight, round(entropy, 6) AS entropy, round(divergence, 6) AS divergence FROM wt",
    "quality_scores": f"""WITH {IND_SQL}, p AS (SELECT user_id, indicator, x, weight FROM long JOIN wt USING (indicator))
        SELECT user_id, round(sum(x * weight), 5) AS "Q_score", {", ".join(f'''round(sum(x * weight) FILTER (indicator IN ({", ".join(f"'{x}'" for x in xs)})) / sum(weight) FILTER (indicator IN ({", ".join(f"'{x}'" for x in xs)})), 5) AS "Q_{d}"''' for d, xs in DIMENSIONS.items())}
        FROM p GROUP BY user_id""",
    "spearman_corr": f"""WITH j AS (SELECT c_acctbal, CAST(count(*) AS DOUBLE) AS n_orders, avg(o_totalprice) AS avg_price, CAST(min(o_orderkey) AS DOUBLE) AS first_key FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal),
        r AS ({" UNION ALL ".join(_rank_sql(x, "c_acctbal") for x in ("n_orders", "avg_price", "first_key"))}), t AS (SELECT *, {_TAIL} AS x FROM r)
        SELECT feature, n, pearson, round(rho, 5) AS spearman, round(({_ERFC}) * exp(-x * x), 5) AS p_value FROM t""",
    "zscore_hybrid": f"""WITH {SCORES_SQL}, z AS (SELECT *, {_Z("Q_score")} AS zq, {_Z("Q_accuracy")} AS za, {_Z("Q_consistency")} AS zc, {_Z("delta")} AS zd FROM base)
        SELECT global_id, round("Q_score", 5) AS "Q_score", round("Q_accuracy", 5) AS "Q_accuracy", round("Q_consistency", 5) AS "Q_consistency", round(delta, 5) AS delta, round(zq, 5) AS "Q_score_z", round(za, 5) AS "Q_accuracy_z",
        round(zc, 5) AS "Q_consistency_z", round(zd, 5) AS delta_z, round(0.5 * zq + 0.5 * zd, 5) AS "hybrid_score_Q", round(0.5 * zc + 0.5 * zd, 5) AS hybrid_score_consistency,
        round(0.8 * zq + 0.2 * zd, 5) AS "hybrid_score_Q08_delta02", round(0.8 * za + 0.2 * zd, 5) AS hybrid_score_accuracy08_delta02 FROM z""",
    "unit_scale": "SELECT s_suppkey, round(s_acctbal, 6) AS s_acctbal, round((s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), 6) AS scaled FROM supplier",
    "value_tiers": """WITH v AS (SELECT c_nationkey, round(avg(c_acctbal), 9) AS value FROM customer GROUP BY c_nationkey), q AS (SELECT quantile_cont(value, CAST(1.0 / 3 AS DOUBLE)) AS a, quantile_cont(value, CAST(2.0 / 3 AS DOUBLE)) AS b FROM v)
        SELECT c_nationkey, CASE WHEN value >= b THEN 'high' WHEN value >= a THEN 'mid' ELSE 'low' END AS tier FROM v, q""",
    "select_random": f"WITH {_POOL_SQL} SELECT global_id FROM p ORDER BY md5(global_id || '|7'), global_id LIMIT 100",
    "bootstrap_intervals": f"""WITH d AS (SELECT o_orderpriority, o_orderkey, CAST(o_totalprice AS DOUBLE) - 150000 AS diff FROM orders), x AS (SELECT *, unnest(range(100)) AS rep FROM d),
        w AS (SELECT o_orderpriority, rep, diff, len(list_filter({_POISSON}, lambda c: CAST('0x' || substr(md5('42|' || (rep // 4) || '|' || o_orderkey), CAST(1 + 8 * (rep % 4) AS INT), 8) AS BIGINT) / 4294967296.0 >= c)) AS w FROM x),
        m AS (SELECT o_orderpriority, rep, sum(w * diff) / sum(w) AS m FROM w GROUP BY ALL), q AS (SELECT o_orderpriority, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM m GROUP BY 1)
        SELECT o_orderpriority, round(avg(diff), 4) AS att, count(*) AS n_pairs, round(any_value(ci_low), 4) AS ci_low, round(any_value(ci_high), 4) AS ci_high FROM d JOIN q USING (o_orderpriority) GROUP BY 1""",
    "group_quantiles": """SELECT l_returnflag, l_linestatus, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.1), 4) AS q10, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 4) AS q50,
        round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.95), 4) AS q95 FROM lineitem GROUP BY 1, 2""",
    "vector_event_signals": """WITH r AS (SELECT l_suppkey AS g, l_orderkey AS k, l_orderkey AS o, [max(CAST(l_quantity AS DOUBLE)) / 50, max(CAST(l_discount AS DOUBLE)) / CAST(0.1 AS DOUBLE), max(CAST(l_tax AS DOUBLE)) / CAST(0.1 AS DOUBLE), max(CAST(l_extendedprice AS DOUBLE)) / 100000] AS vs FROM lineitem GROUP BY ALL),
        u AS (SELECT g, k, o, unnest(range(4)) AS dim, unnest(vs) AS x FROM r), v AS (SELECT g, k, dim, CASE WHEN (o + dim) % 13 <> 0 THEN x END AS v FROM u),
        w AS (SELECT *, row_number() OVER (c ORDER BY k) AS i, row_number() OVER (c ORDER BY k DESC) AS j, count(*) OVER c AS n, abs(v - lag(v) OVER (c ORDER BY k)) AS step FROM v WINDOW c AS (PARTITION BY g, dim)),
        m AS (SELECT *, least(n, greatest(10, floor(n * CAST(0.1 AS DOUBLE)))) AS m FROM w),
        p AS (SELECT g, dim, max(n) AS n, avg(v) FILTER (i <= m) AS head, avg(v) FILTER (j <= m) AS tail, stddev_pop(v) FILTER (j <= m) AS spread, count(v) AS vals, quantile_cont(v, 0.5) AS mid, max(v) - min(v) AS range FROM m GROUP BY ALL),
        a AS (SELECT g, max(n) AS n_frames, avg(abs(tail - head)) AS change_l1, avg(spread) AS final_stability, 1 - sum(vals) / sum(n) AS nan_ratio, coalesce(avg(range), 0) AS range_l1 FROM p GROUP BY g),
        f AS (SELECT g, k, avg(abs(v - coalesce(head, mid))) AS off, avg(step) AS step, min(i) AS i FROM m JOIN p USING (g, dim) GROUP BY g, k),
        s AS (SELECT *, CASE WHEN i = 1 AND off IS NOT NULL THEN 0 ELSE step END AS speed FROM f), q AS (SELECT g, max(off) AS peak, quantile_cont(speed, 0.4) AS calm FROM s GROUP BY g),
        h AS (SELECT s.*, peak, coalesce(peak > 1e-8 AND off >= CAST(0.6 AS DOUBLE) * peak, false) AS moved, coalesce(peak > 1e-8 AND off >= CAST(0.6 AS DOUBLE) * peak AND speed <= coalesce(calm, 0), false) AS held FROM s JOIN q USING (g)),
        z AS (SELECT *, sum(CASE WHEN held THEN 0 ELSE 1 END) OVER (PARTITION BY g ORDER BY k) AS isl FROM h), l AS (SELECT g, max(c) AS stable_len FROM (SELECT g, isl, count(*) FILTER (held) AS c FROM z GROUP BY ALL) GROUP BY g),
        e AS (SELECT g, max(CASE WHEN peak > 1e-8 THEN peak ELSE 0 END) AS peak, avg(CAST(moved AS DOUBLE)) FILTER (off IS NOT NULL) AS active FROM h GROUP BY g)
        SELECT g AS l_suppkey, n_frames, round(change_l1, 6) AS change_l1, round(final_stability, 6) AS final_stability, round(nan_ratio, 6) AS nan_ratio, round(range_l1, 6) AS range_l1, round(peak, 6) AS peak_offset_l1,
        round(active, 6) AS active_ratio, stable_len, round(stable_len * CAST(0.01 AS DOUBLE), 6) AS stable_s FROM a JOIN e USING (g) JOIN l USING (g)""",
    "selection_grid": f"""WITH {_POOL_SQL}, b AS (SELECT global_id, scene_id, score AS q, CAST(global_id % 97 AS DOUBLE) AS d FROM p),
        r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY global_id) AS f, row_number() OVER (ORDER BY md5(global_id || '|5'), global_id) AS rnd, row_number() OVER (ORDER BY q DESC, global_id) AS hi, row_number() OVER (ORDER BY q, global_id) AS lo,
            row_number() OVER (PARTITION BY scene_id ORDER BY q DESC, global_id) AS st, count(*) OVER (PARTITION BY scene_id) AS sn, row_number() OVER (ORDER BY d DESC, global_id) AS hd FROM b),
        j AS (SELECT global_id, unnest([0, 1, 2, 3, 4, 5, 6]) AS job, unnest([f, rnd, hi, hi, lo, st, hd]) AS selected_rank, unnest([1.0, NULL, q, q, q, q, d]::DOUBLE[]) AS selection_score,
            unnest([n, round_even(n * CAST(0.3 AS DOUBLE), 0), round_even(n * CAST(0.2 AS DOUBLE), 0), round_even(n * CAST(0.5 AS DOUBLE), 0), round_even(n * CAST(0.2 AS DOUBLE), 0), round_even(sn * CAST(0.2 AS DOUBLE), 0), round_even(n * CAST(0.5 AS DOUBLE), 0)]) AS most FROM r)
        SELECT global_id, job, selected_rank, selection_score FROM j WHERE selected_rank <= greatest(1, most)""",
    "evaluation_summary": """WITH o AS (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'random' WHEN 1 THEN 'full' ELSE lower(substr(o_orderpriority, 3, 20)) END AS strategy FROM orders),
        m AS (SELECT strategy, CASE WHEN strategy = 'full' THEN 1.0 ELSE round((o_orderkey % 3 + 1) / 4.0, 4) END::DOUBLE AS ratio, o_custkey % 5 AS run_seed, avg(CAST(o_totalprice AS DOUBLE)) / 100000 AS e FROM o GROUP BY ALL),
        r AS (SELECT ratio, avg(e) AS rnd FROM m WHERE strategy = 'random' GROUP BY ratio), f AS (SELECT avg(e) AS whole FROM m WHERE strategy = 'full' AND ratio = 1)
        SELECT strategy, ratio, count(*) AS n_runs, round(avg(e), 6) AS test_nmse_mean, round(stddev_samp(e), 6) AS test_nmse_std, round(avg(exp(-e)), 6) AS test_imitation_score_mean, round(stddev_samp(exp(-e)), 6) AS test_imitation_score_std,
            round(avg((rnd - e) / rnd), 6) AS relative_to_random_nmse_mean, round(avg((whole - e) / whole), 6) AS relative_to_full_nmse_mean FROM m LEFT JOIN r USING (ratio), f GROUP BY strategy, ratio""",
    "prediction_metrics": """WITH r AS (SELECT o_orderpriority, CAST(o_totalprice AS DOUBLE) AS y, o_custkey % 50 * 6000.0::DOUBLE AS p FROM orders),
        k AS (SELECT *, rank() OVER (PARTITION BY o_orderpriority ORDER BY y) + (count(*) OVER (PARTITION BY o_orderpriority, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY o_orderpriority ORDER BY p) + (count(*) OVER (PARTITION BY o_orderpriority, p) - 1) / 2.0 AS rp FROM r)
        SELECT o_orderpriority, count(*) AS n, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(1 - avg((p - y) * (p - y)) / var_pop(y), 4) AS r2, round(corr(y, p), 4) AS pearson, round(corr(ry, rp), 4) AS spearman FROM k GROUP BY 1""",
    "cv_summary": """WITH o AS (SELECT o_orderstatus, o_orderpriority AS fold, CAST(o_totalprice AS DOUBLE) AS y FROM orders), s AS (SELECT fold, sum(y) AS s, count(y) AS n FROM o GROUP BY fold), t AS (SELECT sum(s) AS ts, sum(n) AS tn FROM s),
        p AS (SELECT fold, (ts - s) / (tn - n) AS pred FROM s, t), e AS (SELECT o_orderstatus, fold, avg(abs(pred - y)) AS mae, sqrt(avg((pred - y) * (pred - y))) AS rmse, 1 - avg((pred - y) * (pred - y)) / CASE WHEN var_pop(y) > 1e-12 THEN var_pop(y) END AS r2 FROM o JOIN p USING (fold) GROUP BY ALL)
        SELECT o_orderstatus, count(DISTINCT fold) AS n_folds, round(avg(mae), 4) AS mae_mean, round(stddev_samp(mae), 4) AS mae_std, round(avg(rmse), 4) AS rmse_mean, round(stddev_samp(rmse), 4) AS rmse_std, round(avg(r2), 4) AS r2_mean, round(stddev_samp(r2), 4) AS r2_std FROM e GROUP BY 1""",
    "seeded_splits": f"""WITH {_POOL_SQL}, r AS (SELECT global_id, count(*) OVER (PARTITION BY scene_id) AS n, row_number() OVER (PARTITION BY scene_id ORDER BY md5(global_id || '|42'), global_id) AS a,
        row_number() OVER (PARTITION BY scene_id ORDER BY md5(global_id || '|7'), global_id) AS b, CAST(ntile(5) OVER (PARTITION BY scene_id ORDER BY md5(global_id || '|3'), global_id) - 1 AS INT) AS fold FROM p)
        SELECT global_id, CASE WHEN a <= greatest(1, round_even(n * CAST(0.2 AS DOUBLE), 0)) THEN 'test' ELSE 'pool' END AS test_split,
        CASE WHEN b <= CASE WHEN n = 1 THEN 1 ELSE least(greatest(floor(n * CAST(0.8 AS DOUBLE)), 1), n - 1) END THEN 'train' ELSE 'val' END AS train_split, fold FROM r""",
    "workbook_sheets": r"""WITH p AS (SELECT page_id, left(trim(regexp_replace(substr(url, 1, 20), '[\\/*?:\[\]]', '_', 'g')), 31) AS s FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY page_id) - 1 AS k FROM p)
        SELECT page_id, CASE WHEN k = 0 THEN s ELSE left(s, CAST(31 - length('_' || k) AS INT)) || '_' || k END AS sheet FROM r""",
    "duplicate_uniqueness": """WITH u AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), s AS (SELECT i, avg(x) AS a, stddev_samp(x) AS s FROM u GROUP BY i),
        z AS (SELECT vec_id, list((x - a) / CASE WHEN s > 1e-12 THEN s ELSE 1 END ORDER BY i) AS v FROM u JOIN s USING (i) GROUP BY vec_id),
        d AS (SELECT a.vec_id, min(list_distance(a.v, b.v)) AS d FROM z a JOIN z b ON a.vec_id <> b.vec_id GROUP BY a.vec_id) SELECT vec_id, round(d / max(d) OVER (), 5) AS uniqueness FROM d""",
    "low_variance_filter": """WITH l AS (SELECT l_quantity, l_discount, l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(1 AS DOUBLE) AS one, CAST(NULL AS DOUBLE) AS none FROM lineitem),
        u AS (FROM l UNPIVOT INCLUDE NULLS (x FOR feature IN (l_quantity, l_discount, l_tax, l_linenumber, one, none))), c AS (SELECT feature, x, count(*) AS n FROM u GROUP BY ALL),
        s AS (SELECT feature, count(x) AS n_distinct, max(n) / sum(n) AS dominant_ratio FROM c GROUP BY feature), d AS (SELECT feature, stddev_pop(x) AS std FROM u GROUP BY feature)
        SELECT feature, n_distinct, round(dominant_ratio, 6) AS dominant_ratio, round(std, 6) AS std, CASE WHEN n_distinct = 0 THEN 'all_missing' WHEN n_distinct = 1 THEN 'constant' WHEN dominant_ratio >= 0.995 THEN 'quasi_constant'
        WHEN std < 1e-12 THEN 'low_std' ELSE 'keep' END AS verdict FROM s JOIN d USING (feature)""",
    "scene_profile": """SELECT c_mktsegment AS scene_id, count(*) AS n_trajectories, round(avg(c_acctbal), 6) AS "Q_score_mean", round(coalesce(stddev_samp(c_acctbal), 0), 6) AS "Q_score_std",
        round(min(c_acctbal), 6) AS "Q_score_min", round(max(c_acctbal), 6) AS "Q_score_max" FROM customer GROUP BY c_mktsegment""",
    "delta_stability": """WITH r AS (SELECT o_orderpriority AS scene_id, o_orderkey % 3 AS seed, round(avg(o_totalprice - 150000), 4) AS delta FROM orders GROUP BY ALL),
        s AS (SELECT scene_id, count(DISTINCT seed) AS n_runs, avg(delta) AS m, coalesce(stddev_samp(delta), 0) AS s, min(delta) AS lo, max(delta) AS hi, avg(CAST(delta > 0 AS DOUBLE)) AS p FROM r GROUP BY scene_id)
        SELECT scene_id, n_runs, round(m, 4) AS delta_mean, round(s, 4) AS delta_std, round(lo, 4) AS delta_min, round(hi, 4) AS delta_max, round(p, 4) AS delta_positive_rate, CAST(rank() OVER (ORDER BY m DESC) AS INT) AS rank FROM s""",
    "marginal_value": """WITH s AS (SELECT c_mktsegment AS scene_id, count(*) AS n, sum(c_acctbal) AS s, sum(c_acctbal * c_acctbal) AS q FROM customer GROUP BY 1), t AS (SELECT sum(n) AS tn, sum(s) AS ts FROM s),
        m AS (SELECT scene_id, q / n AS q, s / n AS a, ts / tn AS b, (ts - s) / (tn - n) AS l FROM s, t)
        SELECT scene_id, round(q - 2 * b * a + b * b, 5) AS base_mse, round(q - 2 * l * a + l * l, 5) AS leave_mse, round((q - 2 * l * a + l * l) - (q - 2 * b * a + b * b), 5) AS delta FROM m""",
    "train_mean_baseline": """WITH s AS (SELECT o_orderpriority AS fold, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(s) AS ts, sum(n) AS tn FROM s), m AS (SELECT fold, (ts - s) / (tn - n) AS pred FROM s, t)
        SELECT fold, count(*) AS n, round(avg(abs(pred - o_totalprice)), 4) AS mae, round(sqrt(avg((pred - o_totalprice) * (pred - o_totalprice))), 4) AS rmse FROM orders JOIN m ON fold = o_orderpriority GROUP BY fold""",
    "master_table": f"WITH {_MASTER_SQL} SELECT c_custkey, c_nationkey, round(c_acctbal, 8) AS c_acctbal, n_orders, round(avg_price, 8) AS avg_price, n_name FROM m",
    "master_check": f"""WITH {_MASTER_SQL} SELECT count(*) AS n_rows, count(DISTINCT c_custkey) AS n_keys, count(*) > count(DISTINCT c_custkey) AS has_duplicates,
        count(*) FILTER (avg_price IS NULL) AS avg_price_missing, count(*) FILTER (n_name IS NULL) AS n_name_missing FROM m""",
    "union_distinct": "SELECT o_orderpriority, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) GROUP BY 1",
    "pivot_means": """SELECT o_orderpriority, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS "F", round(avg(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS "O", round(avg(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS "P" FROM orders GROUP BY 1""",
    "grouped_heterogeneity": "SELECT coalesce(c_mktsegment, 'all') AS grp, count(*) AS n, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY GROUPING SETS ((c_mktsegment), ())",
    "dominant_values": """WITH n AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderpriority, first(o_orderstatus ORDER BY n DESC, o_orderstatus) AS mode, round(max(n) / sum(n), 6) AS share FROM n GROUP BY 1""",
    "histogram": """WITH b AS (SELECT l_returnflag, CAST(least(floor((l_quantity - 1) / 12.5), 3) AS BIGINT) AS bin FROM lineitem) SELECT l_returnflag, bin, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share FROM b GROUP BY 1, 2""",
    "select_top": f"WITH {_POOL_SQL} SELECT global_id, row_number() OVER (ORDER BY score DESC, global_id) AS selected_rank FROM p ORDER BY score DESC, global_id LIMIT 40",
    "select_low": f"WITH {_POOL_SQL} SELECT global_id, row_number() OVER (ORDER BY score, global_id) AS selected_rank FROM p ORDER BY score, global_id LIMIT 40",
    "select_stratified": f"""WITH {_POOL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY score DESC NULLS LAST, global_id) AS rn, count(*) OVER (PARTITION BY scene_id) AS n FROM p)
        SELECT global_id, scene_id FROM r WHERE rn <= greatest(1, round_even(n * CAST(0.15 AS DOUBLE), 0))""",
    "split_train_val": f"""WITH {_POOL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY global_id) AS rn, count(*) OVER (PARTITION BY scene_id) AS n FROM p)
        SELECT global_id, CASE WHEN rn <= CASE WHEN n = 1 THEN 1 ELSE least(greatest(floor(n * CAST(0.8 AS DOUBLE)), 1), n - 1) END THEN 'train' ELSE 'val' END AS split FROM r""",
    "split_test_pool": f"""WITH {_POOL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY global_id) AS rn, count(*) OVER (PARTITION BY scene_id) AS n FROM p)
        SELECT global_id, CASE WHEN rn <= greatest(1, round_even(n * CAST(0.2 AS DOUBLE), 0)) THEN 'test' ELSE 'pool' END AS split FROM r""",
    "k_folds": f"WITH {_POOL_SQL} SELECT global_id, CAST(ntile(5) OVER (PARTITION BY scene_id ORDER BY global_id) - 1 AS INT) AS fold FROM p",
    "curation_curve": f"WITH {_CURVE_SQL} SELECT scene_id, ratio, n, round(mean, 4) AS mean, round(stderr, 4) AS stderr FROM c",
    "min_ratio": f"WITH {_CURVE_SQL}, b AS (SELECT scene_id, mean AS base FROM c WHERE ratio = 1.0) SELECT scene_id, min(ratio) FILTER (mean >= 0.95 * base) AS min_ratio FROM c JOIN b USING (scene_id) GROUP BY scene_id",
    "cumulative_value": f"""WITH {_POOL_SQL}, v AS (SELECT scene_id, round(avg(score), 9) AS value FROM p GROUP BY scene_id)
        SELECT scene_id, row_number() OVER (ORDER BY value DESC, scene_id) AS position, round(avg(value) OVER (ORDER BY value DESC, scene_id ROWS UNBOUNDED PRECEDING), 6) AS cum_mean FROM v""",
    "pending_jobs": """WITH g AS (SELECT 'full' AS strategy, CAST(1.0 AS DECIMAL(6,4)) AS ratio, 0 AS run_seed UNION ALL SELECT 'high_Q_global', CAST(r AS DECIMAL(6,4)), s FROM (VALUES (0.2), (0.5), (1.0)) a(r), (VALUES (0), (1)) b(s)
        UNION ALL SELECT 'random', CAST(r AS DECIMAL(6,4)), s FROM (VALUES (0.2), (0.5), (1.0)) a(r), (VALUES (0), (1), (2)) b(s)) SELECT strategy, CAST(ratio AS DOUBLE) AS ratio, run_seed FROM g ANTI JOIN (SELECT * FROM g WHERE strategy = 'random' AND ratio = 0.5 OR run_seed = 1) d USING (strategy, ratio, run_seed)""",
    "curation_summary": f"""WITH {SCORES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY "Q_score" DESC, global_id) AS hi, row_number() OVER (PARTITION BY scene_id ORDER BY "Q_score", global_id) AS lo, count(*) OVER (PARTITION BY scene_id) AS n FROM base),
        k AS (SELECT * FROM (VALUES ('high', CAST(0.2 AS DOUBLE)), ('high', 0.5), ('low', 0.2), ('low', 0.5), ('full', 1.0)) x(strategy, ratio)),
        m AS (SELECT strategy, ratio, global_id % 3 AS seed, avg("Q_accuracy") AS metric FROM r, k WHERE CASE strategy WHEN 'low' THEN lo ELSE hi END <= greatest(1, round_even(n * ratio, 0)) GROUP BY ALL),
        ss AS (SELECT strategy, ratio, count(*) AS n_runs, avg(metric) AS a, stddev_samp(metric) AS d FROM m GROUP BY ALL), f AS (SELECT a AS full_mean FROM ss WHERE strategy = 'full')
        SELECT strategy, round(ratio, 4) AS ratio, n_runs, round(a, 4) AS metric_mean, round(d, 4) AS metric_std, round((a - full_mean) / full_mean, 4) AS gain_vs_full FROM ss, f""",
    "dual_scores": """SELECT c_custkey AS global_id, round(CAST(c_acctbal AS DOUBLE) * 0.5 + c_nationkey * 0.5, 6) AS dual_score,
        CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'fixed' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'moving' ELSE 'other' END AS task_group FROM customer""",
    "value_with_labels": """SELECT c_custkey AS global_id, c_mktsegment AS scene_id, n_orders, CAST(c_acctbal > 0 AS INT) AS final_label
        FROM customer JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o ON o_custkey = c_custkey""",
    "group_value_summary": """SELECT c_mktsegment AS scene_id, count(*) AS n_trajectories, round(avg(CAST(c_acctbal AS DOUBLE)), 4) AS value_mean, round(stddev_samp(CAST(c_acctbal AS DOUBLE)), 4) AS value_std,
        arg_min(c_nationkey, c_custkey) AS c_nationkey FROM customer GROUP BY 1""",
    "random_baseline": f"""WITH {_POOL_SQL}, d AS (SELECT rep, CAST(score AS DOUBLE) AS v, CAST('0x' || substr(md5(concat_ws('|', global_id, 42, rep)), 1, 8) AS BIGINT) AS u FROM p, range(20) AS r(rep)),
        m AS (SELECT ratio, rep, avg(v) AS m FROM d, (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(1.0 AS DOUBLE))) AS q(ratio) WHERE u < ratio * 4294967296 GROUP BY ALL)
        SELECT ratio, count(m) AS n_repeats, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS std FROM m GROUP BY ratio""",
    "folds_of_all": f"WITH {_POOL_SQL} SELECT global_id, CAST(ntile(7) OVER (ORDER BY global_id) - 1 AS INT) AS fold FROM p",
    "cumulative_of_all": f"""WITH {_POOL_SQL} , k AS (SELECT global_id, CAST(round(score * 100) AS BIGINT) AS cents FROM p)
        SELECT global_id, row_number() OVER w AS position, CAST(sum(cents) OVER (w ROWS UNBOUNDED PRECEDING) AS DOUBLE) / row_number() OVER w AS cum_mean FROM k WINDOW w AS (ORDER BY cents, global_id)""",
    "scatter_points": """SELECT p_partkey, feature, round(x, 4) AS x, value FROM (SELECT p_partkey, 'size' AS feature, CAST(p_size AS DOUBLE) AS x, p_partkey % 10 AS value FROM part
        UNION ALL SELECT p_partkey, 'price', CAST(p_retailprice AS DOUBLE), p_partkey % 10 FROM part) WHERE x IS NOT NULL""",
    "ordered_messages": "SELECT l_returnflag, min(l_orderkey) AS first_position, count(*) AS n FROM lineitem GROUP BY 1",
    "depth_features": """WITH d AS (SELECT vec_id, list_filter(embedding, lambda v: v > 0)::DOUBLE[] AS k, len(embedding) AS n FROM embeddings WHERE len(embedding) > 0)
        SELECT vec_id, round(list_avg(k), 5) AS mean, round(list_stddev_pop(k), 5) AS std, round(1 - len(k) / n, 5) AS hole_ratio FROM d""",
    "confounder_choice": "SELECT unnest(['c_acctbal', 'c_nationkey']) AS covariate",
    "rank_desc": "WITH v AS (SELECT p_brand, max(p_size) AS v FROM part GROUP BY p_brand) SELECT p_brand, v, CAST(rank() OVER (ORDER BY v DESC) AS INT) AS rank FROM v",
    "boxplot": """WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders GROUP BY 1)
        SELECT o_orderpriority, round(any_value(a), 4) AS q1, round(any_value(b), 4) AS median, round(any_value(c), 4) AS q3, round(min(o_totalprice) FILTER (o_totalprice BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a)), 4) AS low,
        round(max(o_totalprice) FILTER (o_totalprice BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a)), 4) AS high FROM orders JOIN q USING (o_orderpriority) GROUP BY 1""",
    "radar_extremes": """WITH v AS (SELECT s_nationkey, round(avg(s_acctbal), 9) AS score FROM supplier GROUP BY 1), r AS (SELECT s_nationkey, row_number() OVER (ORDER BY score DESC, s_nationkey) AS a, row_number() OVER (ORDER BY score, s_nationkey) AS b FROM v)
        SELECT s_nationkey, 'top' AS side FROM r WHERE a <= 5 UNION ALL SELECT s_nationkey, 'bottom' FROM r WHERE b <= 5""",
    "robustness_rollup": f"WITH {_EFFECT_SQL} SELECT grp, outcome, count(DISTINCT threshold) AS n_thresholds, round(avg(att), 4) AS mean_att, round(avg(CAST(att > 0 AS DOUBLE)), 4) AS positive_rate FROM f GROUP BY ALL",
    "treatments": f"""WITH {_POOL_SQL}, q AS (SELECT quantile_cont(score, 0.5) AS a, quantile_cont(score, 0.6) AS b FROM p) SELECT global_id, CAST(score >= a AS INT) AS t_score_q50, CAST(score >= b AS INT) AS t_score_q60 FROM p, q""",
    "balance_smd": f"""WITH {SCORES_SQL}, q AS (SELECT quantile_cont("Q_score", 0.5) AS q50 FROM base), r AS (SELECT "Q_accuracy", "Q_consistency", "Q_score" >= q50 AS t FROM base, q)
        {" UNION ALL ".join(f'''SELECT '{c}' AS covariate, round((avg("{c}") FILTER (t) - avg("{c}") FILTER (NOT t)) / sqrt(greatest((var_samp("{c}") FILTER (t) + var_samp("{c}") FILTER (NOT t)) / 2, 1e-12)), 5) AS smd FROM r''' for c in ("Q_accuracy", "Q_consistency"))}""",
    "trajectory_errors": f"""WITH {_ERRORS_SQL} SELECT global_id, scene_id, round(mse, 6) AS trajectory_mse, round(mae, 6) AS trajectory_mae, round(nmse, 6) AS trajectory_normalized_mse, n_bc_windows,
        round(exp(-nmse), 6) AS trajectory_imitation_score FROM e""",
    "label_summary": f"""WITH {_ERRORS_SQL} SELECT scene_id, count(*) AS n_trajectories, round(avg(nmse), 6) AS trajectory_normalized_mse_mean, round(stddev_samp(nmse), 6) AS trajectory_normalized_mse_std,
        round(avg(exp(-nmse)), 6) AS trajectory_imitation_score_mean, round(stddev_samp(exp(-nmse)), 6) AS trajectory_imitation_score_std FROM e GROUP BY scene_id""",
    "balance_brief": """SELECT p_brand AS treatment, count(p_name) AS n_covariates, round(avg(p_size / 100.0), 6) AS mean_abs_smd_before, round(avg(p_size / 200.0), 6) AS mean_abs_smd_after,
        count(*) FILTER (p_size / 200.0 < 0.1) AS n_good_after FROM part GROUP BY p_brand""",
}
