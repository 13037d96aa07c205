"""Scene profiles, marginal value, score tables, the selection grid with resume, and the summaries of its runs."""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.operators import training
from kinetrail.operators.order import running
from kinetrail.operators.scoring import beside, zscore
from kinetrail.sources.store import scratch


def stack(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, columns matched by name, missing ones NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def group_profile(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Count and mean, std (ddof 1; 0 for one row), min, max of each column."""
    per = [x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))]
    return df.groupBy(*by).agg(F.count("*").alias("n_trajectories"), *per)


def delta_stability(runs: DataFrame, by: list[str], seed: str, delta: str) -> DataFrame:
    """Over seeds: distinct runs, mean, std, min, max, share above 0, and the rank of the mean (largest 1, ties share)."""
    found = runs.groupBy(*by).agg(
        F.countDistinct(seed).alias("n_runs"), F.avg(delta).alias(f"{delta}_mean"), F.coalesce(F.stddev_samp(delta), F.lit(0.0)).alias(f"{delta}_std"),
        F.min(delta).alias(f"{delta}_min"), F.max(delta).alias(f"{delta}_max"), F.avg((F.col(delta) > 0).cast("double")).alias(f"{delta}_positive_rate"),
    )
    from kinetrail.operators.reports import rank_desc

    return rank_desc(found, f"{delta}_mean")


def leave_one_out_value(df: DataFrame, scene: str, y: str) -> DataFrame:
    """(scene, base_mse, leave_mse, delta): what a mean predictor loses on a scene when it doesn't train on it.

    All means come from per-scene sums, so it's one pass over the rows.
    """
    s = df.groupBy(scene).agg(F.count(y).alias("_n"), F.sum(y).alias("_s"), F.sum(F.col(y) * F.col(y)).alias("_q"))
    total = s.agg(F.sum("_n").alias("_tn"), F.sum("_s").alias("_ts"))
    mse = lambda m: F.col("_q") / F.col("_n") - 2 * m * F.col("_s") / F.col("_n") + m * m
    base = F.col("_ts") / F.col("_tn")
    leave = (F.col("_ts") - F.col("_s")) / F.nullif(F.col("_tn") - F.col("_n"), F.lit(0))
    return beside(s, total).select(scene, mse(base).alias("base_mse"), mse(leave).alias("leave_mse"), (mse(leave) - mse(base)).alias("delta"))


def trajectory_values(trajectories: DataFrame, scene_values: DataFrame, scene: str, predictions: DataFrame | None = None) -> DataFrame:
    """Trajectories with their scene's value; where it's missing, the predicted one, and a column that says which."""
    df = trajectories.join(scene_values.withColumnRenamed("delta", "delta_emp"), scene, "left")
    if predictions is None:
        df = df.withColumn("delta_pred", F.lit(None).cast("double"))
    else:
        df = df.join(predictions.select(scene, F.col("pred").alias("delta_pred")), scene, "left")
    source = F.when(F.col("delta_emp").isNotNull(), "empirical").when(F.col("delta_pred").isNotNull(), "predicted")
    return df.withColumns({"delta": F.coalesce("delta_emp", "delta_pred"), "value_source": source})


def master_table(customer: DataFrame, orders: DataFrame, nation: DataFrame) -> DataFrame:
    """A chain of left joins on one key: base rows, order features, a small dimension."""
    per = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("avg_price"))
    dim = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return customer.select("c_custkey", "c_nationkey", "c_acctbal").join(per, "c_custkey", "left").join(dim, "c_nationkey", "left")


def integrity(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: rows, distinct keys, whether any repeats, and missing values by column."""
    return df.agg(
        F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), (F.count("*") > F.countDistinct(key)).alias("has_duplicates"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in columns],
    )


def customer_scores(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """A score table from customers: three scores and the scene's value."""
    per = orders.groupBy(F.col("o_custkey").alias("global_id")).agg(F.avg("o_totalprice").alias("Q_accuracy"), F.count("*").cast("double").alias("Q_consistency"))
    df = customer.select(F.col("c_custkey").alias("global_id"), F.col("c_mktsegment").alias("scene_id"), F.col("c_acctbal").alias("Q_score")).join(per, "global_id", "left")
    df = df.fillna(0.0, ["Q_accuracy", "Q_consistency"])
    return df.join(df.groupBy("scene_id").agg(F.avg("Q_accuracy").alias("delta")), "scene_id")


def hybrid_scores(df: DataFrame, q: str, accuracy: str, consistency: str, delta: str, fit_on=None) -> DataFrame:
    """z-scores and their fixed mixtures. ``fit_on``: rows that set mean and spread (default all)."""
    df = zscore(df, [q, accuracy, consistency, delta], fit_on=fit_on)
    z = lambda c: F.col(f"{c}_z")
    return df.withColumns({
        "hybrid_score_Q": 0.5 * z(q) + 0.5 * z(delta), "hybrid_score_consistency": 0.5 * z(consistency) + 0.5 * z(delta),
        "hybrid_score_Q08_delta02": 0.8 * z(q) + 0.2 * z(delta), "hybrid_score_accuracy08_delta02": 0.8 * z(accuracy) + 0.2 * z(delta),
    })


#: strategy: (score column, largest first); full, random and stratified are handled by name
STRATEGIES = {
    "high_Q_global": ("Q_score", True), "low_Q_score": ("Q_score", False), "high_delta": ("delta", True), "low_delta": ("delta", False),
    "hybrid_Q_delta": ("hybrid_score_Q", True), "hybrid_consistency_delta": ("hybrid_score_consistency", True),
    "hybrid_Q08_delta02": ("hybrid_score_Q08_delta02", True), "hybrid_accuracy08_delta02": ("hybrid_score_accuracy08_delta02", True),
}


def select_ids(pool: DataFrame, strategy: str, ratio: float, seed: int = 0) -> DataFrame:
    """Rows of the pool that a strategy picks, max(1, round(n ratio)) of them, with ``selection_score``."""
    from kinetrail.operators import ranking as R

    n = max(1, round(pool.count() * ratio))
    if strategy == "full":
        return pool.withColumn("selection_score", F.lit(1.0))
    if strategy == "random":
        return R.random_n(pool, "global_id", n, seed).withColumn("selection_score", F.lit(None).cast("double"))
    if strategy == "high_Q_stratified":
        return R.top_share_per_group(pool, "scene_id", "Q_score", "global_id", ratio).withColumn("selection_score", F.col("Q_score"))
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    score, largest = STRATEGIES[strategy]
    return R.top_n(pool, score, "global_id", n, largest).withColumn("selection_score", F.col(score))


def mark_selections(pool: DataFrame, jobs: list[tuple[str, float, int]]) -> DataFrame:
    """The pool's rows with ``picks``: an array of (job, selected_rank, selection_score), one for each job that picks the row.

    Every order that some job needs (a score up or down, a seed's hash, scores within scenes) is placed once, slice by
    slice; all ratios then only compare a place with max(1, round(n ratio)). Sizes and ties are those of
    :func:`select_ids`: ids break ties, rows without the score are not picked, random order comes from a hash of the id.
    """
    from kinetrail.operators.ranking import half_even, hash_order

    n = pool.count()
    df, places, picks = pool, {}, []

    def placed(key: tuple, by: list[str], order: list[Column], there: Column | None) -> Column:
        nonlocal df
        if key not in places:
            places[key] = f"_p{len(places)}"
            df = df.withColumn("_there", there if there is not None else F.lit(True))
            df = running(df, by, [F.desc("_there"), *order]).withColumnRenamed("_place", places[key])
            df = df.withColumn(places[key], F.when(F.col("_there"), F.col(places[key]))).drop("_there")
        return F.col(places[key])

    sizes = pool.groupBy("scene_id").agg(F.count("*").alias("_scene_n")) if any(s == "high_Q_stratified" for s, _, _ in jobs) else None
    for i, (strategy, ratio, seed) in enumerate(jobs):
        most, none = F.lit(max(1, round(n * ratio))), F.lit(None).cast("double")
        if strategy == "full":
            place, score, most = placed(("full",), [], [F.asc("global_id")], None), F.lit(1.0), F.lit(n)
        elif strategy == "random":
            place, score = placed(("random", seed), [], [hash_order("global_id", seed), F.asc("global_id")], None), none
        elif strategy == "high_Q_stratified":
            place, score = placed(("scene",), ["scene_id"], [F.desc_nulls_last("Q_score"), F.asc("global_id")], None), F.col("Q_score")
            most = F.greatest(F.lit(1).cast("long"), half_even(F.col("_scene_n") * F.lit(float(ratio))))
        elif strategy in STRATEGIES:
            name, largest = STRATEGIES[strategy]
            place, score = placed((name, largest), [], [F.desc(name) if largest else F.asc(name), F.asc("global_id")], F.col(name).isNotNull()), F.col(name)
        else:
            raise ValueError(f"unknown strategy: {strategy}")
        picks.append(F.when(place <= most, F.struct(F.lit(i).alias("job"), place.cast("long").alias("selected_rank"), score.cast("double").alias("selection_score"))))
    if sizes is not None:
        df = df.join(sizes, "scene_id")
    return df.withColumn("picks", F.array_compact(F.array(*picks))).drop("_scene_n", *places.values())


def job_grid(spark: SparkSession, strategies: list[str], ratios: list[float], run_seeds: list[int], random_seeds: list[int]) -> DataFrame:
    """(strategy, ratio, run_seed): full once, random with its own seeds, others with the run seeds.

    Ratios are decimals so that keys compare exactly.
    """
    rows = [(s, float(r), int(k)) for s in strategies for r in ([1.0] if s == "full" else ratios) for k in ([0] if s == "full" else random_seeds if s == "random" else run_seeds)]
    return spark.createDataFrame(rows, "strategy string, ratio double, run_seed int").withColumn("ratio", F.col("ratio").cast("decimal(6,4)"))


def pending(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs without a stored result; a result table that lacks the key columns counts as empty."""
    keys = ["strategy", "ratio", "run_seed"]
    if not set(keys) <= set(done.columns):
        return grid
    return grid.join(done.select("strategy", F.col("ratio").cast("decimal(6,4)").alias("ratio"), F.col("run_seed").cast("int").alias("run_seed")).distinct(), keys, "left_anti")


def proxy_runs(df: DataFrame, strategies: list[str], ratios: list[float], n_seeds: int) -> DataFrame:
    """A cheap metric of each selection: the mean accuracy of every seed's share of the rows picked by score.

    Seeds deal rows by id modulo the number of seeds. Both orders are placed slice by slice, once for all ratios.
    """
    from kinetrail.operators.ranking import half_even, placed

    rows = placed(df, "scene_id", [F.desc("Q_score"), F.asc("global_id")]).withColumnRenamed("_place", "_high")
    if any(s == "low" for s in strategies):
        rows = running(rows, ["scene_id"], [F.asc("Q_score"), F.asc("global_id")]).withColumnRenamed("_place", "_low")
    picks = []
    for s in strategies:
        for r in [1.0] if s == "full" else ratios:
            most = F.greatest(F.lit(1).cast("long"), half_even(F.col("_n") * F.lit(float(r))))
            picks.append(F.when(F.col("_low" if s == "low" else "_high") <= most, F.struct(F.lit(s).alias("strategy"), F.lit(float(r)).alias("ratio"))))
    picked = rows.select("global_id", "Q_accuracy", F.explode(F.array_compact(F.array(*picks))).alias("job"))
    return picked.groupBy("job.strategy", "job.ratio", (F.col("global_id") % n_seeds).alias("run_seed")).agg(F.avg("Q_accuracy").alias("metric"))


def evaluation_summary(metrics: DataFrame) -> DataFrame:
    """By (strategy, ratio): runs, mean and deviation of test error and imitation score, and the mean relative gain in error.

    Gains are (reference - own) / reference: against the mean of random selections of the same ratio, and against the
    full set (at ratio 1); NULL where there is none.
    """
    at = F.col("ratio").cast("decimal(6,4)")
    random = metrics.where("strategy = 'random'").groupBy(at.alias("_r")).agg(F.avg("test_nmse").alias("_random"))
    full = metrics.agg(F.avg(F.when((F.col("strategy") == "full") & (at == 1), F.col("test_nmse"))).alias("_full"))
    runs = beside(metrics.join(random, at == F.col("_r"), "left"), full)
    gain = lambda base: F.when(F.col(base) > 0, (F.col(base) - F.col("test_nmse")) / F.col(base))
    runs = runs.withColumns({"relative_to_random_nmse": gain("_random"), "relative_to_full_nmse": gain("_full")})
    both = [f(c).alias(f"{c}_{n}") for c in ("test_nmse", "test_imitation_score") for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return runs.groupBy("strategy", "ratio").agg(F.count("run_seed").alias("n_runs"), *both, *[F.avg(c).alias(f"{c}_mean") for c in ("relative_to_random_nmse", "relative_to_full_nmse")])


def curation_summary(runs: DataFrame, metric: str, full: str = "full") -> DataFrame:
    """(strategy, ratio): count, mean, std (NULL for one run) and the relative gain against the full set's mean."""
    found = runs.groupBy("strategy", "ratio").agg(F.count("*").alias("n_runs"), F.avg(metric).alias(f"{metric}_mean"), F.stddev_samp(metric).alias(f"{metric}_std"))
    base = found.agg(F.max(F.when(F.col("strategy") == full, F.col(f"{metric}_mean"))).alias("_full"))
    gain = (F.col(f"{metric}_mean") - F.col("_full")) / F.nullif(F.col("_full"), F.lit(0.0))
    return beside(found, base).withColumn("gain_vs_full", gain).drop("_full")


def scene_values(samples: DataFrame, scenes: list[str], seeds: list[int], epochs: int = 35, **how) -> DataFrame:
    """(seed, scene_id, base_score, leave_score, delta_score): networks with all scenes against networks without one.

    ``samples``: sample_id, scene_id, x, y, is_val. One job for each seed and held-out scene (and one without), trained
    side by side by gradient sums; each scene is scored on its validation windows. Scores of a job without training rows
    are NULL.
    """
    spark = samples.sparkSession
    scale = training.target_scale(samples.where("NOT is_val"))
    jobs = [{"seed": s, "heldout": h} for s in seeds for h in ["", *scenes]]
    train = training.job_numbers(jobs, lambda j: ~F.col("is_val") & (F.col("scene_id") != j["heldout"]))
    test = training.job_numbers(jobs, lambda j: F.col("is_val") & ((j["heldout"] == "") | (F.col("scene_id") == j["heldout"])))
    rows = scratch(samples.select("sample_id", "scene_id", "x", "y", train.alias("train"), test.alias("test")), "value-rows")
    trained = training.train_networks(rows, [zlib.crc32(f"{j['seed']}|{j['heldout']}".encode()) for j in jobs], epochs=epochs, **how)
    told = spark.createDataFrame([(i, j["seed"], j["heldout"]) for i, j in enumerate(jobs)], "job int, seed int, heldout string")
    scores = training.imitation(training.window_errors(rows, trained, scale, keep=["scene_id"]), ["job", "scene_id"]).join(F.broadcast(told), "job")
    scores = scratch(scores, "scene-scores")
    base = scores.where("heldout = ''").select("seed", "scene_id", F.col("imitation_score").alias("base_score"), F.col("normalized_mse").alias("base_nmse"))
    leave = scores.where("heldout = scene_id").select("seed", "scene_id", F.col("imitation_score").alias("leave_score"), F.col("normalized_mse").alias("leave_nmse"))
    both = base.join(leave, ["seed", "scene_id"], "left")
    return both.withColumns({"delta_score": F.col("base_score") - F.col("leave_score"), "delta_nmse": F.col("leave_nmse") - F.col("base_nmse")})


def joined_on_shared(left: DataFrame, right: DataFrame, key_sets: list[list[str]]) -> DataFrame:
    """Inner join on the first of ``key_sets`` whose columns both sides have; other shared columns are the left's."""
    for keys in key_sets:
        if all(k in left.columns and k in right.columns for k in keys):
            return left.join(right.drop(*[c for c in right.columns if c in left.columns and c not in keys]), keys)
    raise ValueError("no set of keys is on both sides")


def value_summary(df: DataFrame, by: list[str], id_col: str, means: list[str], constants: list[str]) -> DataFrame:
    """Rows and mean, std (ddof 1) of ``means`` by group; of ``constants`` the value of the smallest id."""
    figures = [f(c).alias(f"{c}_{n}") for c in means for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return df.groupBy(*by).agg(F.count("*").alias("n_trajectories"), *figures, *[F.min_by(c, id_col).alias(c) for c in constants])
