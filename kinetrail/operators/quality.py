"""Quality indicators of trajectories (C3 to C23) and the checks on their composite."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.functions.columns import clip, mean_of, quantile, safe_corr, safe_ratio, share_present
from kinetrail.operators import models, neighbours
from kinetrail.operators import scoring as S
from kinetrail.operators import timeseries as T
from kinetrail.sources.store import scratch

# The fields whose presence C6 and C23 count.
METADATA_FIELDS = ["scene_id", "task_name", "object_id", "trajectory_id", "manufacturer", "equipment_model", "created_at", "collection_duration_in_ms"]
DESCRIPTION_FIELDS = ["scene_id", "task_name", "object_id", "resource_id", "owner", "region", "manufacturer", "equipment_model", "equipment_sn"]


def visual_completeness(matches: DataFrame, by: list[str], camera: str, duration: str, fps: float = 30.0) -> DataFrame:
    """C3: mean over cameras of matched frames over max(1, duration fps)."""
    per = matches.groupBy(*by, camera).agg(F.count("*").alias("n"), F.max(duration).alias("d"))
    return per.groupBy(*by).agg(F.avg(safe_ratio("n", F.greatest(F.lit(1.0), F.col("d") * fps))).alias("C3"))


def depth_validity(df: DataFrame, hole_ratios: list[str]) -> DataFrame:
    """C4: 1 - the mean of the hole ratios that are there."""
    return df.withColumn("C4", clip(1 - mean_of(*hole_ratios)))


def joint_completeness(df: DataFrame, by: list[str], duration: str, values: list[str], rate: float = 100.0) -> DataFrame:
    """C5: mean of length against floor(duration rate) + 1 and 1 - the mean share of missing samples."""
    gaps = [F.avg(F.col(v).isNull().cast("double")) for v in values]
    length = safe_ratio(F.count("*"), F.floor(F.max(duration) * rate) + 1)
    return df.groupBy(*by).agg(mean_of(length, 1 - mean_of(*gaps)).alias("C5"))


def attribute_completeness(df: DataFrame, fields: list[str] = METADATA_FIELDS, into: str = "C6") -> DataFrame:
    """C6, C23: the share of fields that hold something; fields without a column count as empty."""
    return df.withColumn(into, share_present(*[F.col(f) if f in df.columns else F.lit(None).cast("string") for f in fields]))


def alignment_quality(df: DataFrame, offsets_ms: list[str], bound_ms: float = 50.0) -> DataFrame:
    """C16: 1 - the mean of streams' mean offsets over the bound."""
    return df.withColumn("C16", clip(1 - mean_of(*offsets_ms) / bound_ms))


def joint_indicators(df: DataFrame, by: list[str], order: str, dim: str, value: str) -> DataFrame:
    """C8, C10 and C18 of a group of joint channels given long: one row a trajectory.

    C8 looks at the mean size of all channels' first, second and third differences, C10 adds up all channels' energies,
    C18 is the mean absolute correlation over pairs of channels (NULL under three samples or two varying channels).
    """
    # dealt out by trajectory once: what follows groups by more than that and moves nothing again
    df = df.select(*by, order, dim, value).repartition(*[F.col(c) for c in by])
    w = W.partitionBy(*by, dim).orderBy(order)
    v, (a, b, d) = F.col(value), [F.lag(value, i).over(w) for i in (1, 2, 3)]
    rows = df.select(*by, order, v.alias("v"), F.abs(v - a).alias("s1"), F.abs(v - 2 * a + b).alias("s2"), F.abs(v - 3 * a + 3 * b - d).alias("s3"), (v - F.avg(value).over(W.partitionBy(*by, dim))).alias("c"))
    steps = rows.groupBy(*by, order).agg(*[F.avg(s).alias(s) for s in ("s1", "s2", "s3")], F.sum(F.col("c") ** 2).alias("e"), F.sum(F.col("s2") ** 2).alias("e2"))
    scored = T.robust_z(steps, by, {"s1": "z1", "s2": "z2", "s3": "z3"})
    odd = [F.coalesce(F.abs(z) > 3.5, F.lit(False)) for z in ("z1", "z2", "z3")]
    e, e2 = F.coalesce(F.sum("e"), F.lit(0.0)), F.coalesce(F.sum("e2"), F.lit(0.0))
    found = scored.groupBy(*by).agg(
        F.when(F.count("*") >= 4, 1 - F.avg(F.when(F.col("s1").isNotNull(), (odd[0] | odd[1] | odd[2]).cast("double")))).alias("C8"),
        F.when(F.count("*") < 4, None).when(e <= 1e-12, F.lit(1.0)).otherwise(1 - e2 / F.nullif(e2 + e, F.lit(0.0))).alias("C10"),
    )
    # a sample's channels pair up within its row; a pair's correlation is one aggregate, added up before it moves
    cells = F.sort_array(F.collect_list(F.struct(F.col(dim).alias("d"), F.col(value).cast("double").alias("v"))))
    frames = df.groupBy(*by, order).agg(cells.alias("_f"))
    both = F.flatten(F.transform("_f", lambda p, i: F.transform(F.slice("_f", i + 2, F.size("_f")), lambda q: F.struct(p["d"].alias("_p"), q["d"].alias("_q"), p["v"].alias("_x"), q["v"].alias("_y")))))
    pairs = frames.select(*by, F.inline(both)).groupBy(*by, "_p", "_q").agg(F.when(F.count("*") >= 3, F.abs(safe_corr("_x", "_y"))).alias("r"))
    return found.join(pairs.groupBy(*by).agg(F.avg("r").alias("C18")), by, "left")


def label_completeness(df: DataFrame, fields: list[str], into: str = "C21") -> DataFrame:
    """C21: the share of label fields that hold something; 0 for a trajectory without labels."""
    return df.withColumn(into, F.coalesce(share_present(*fields), F.lit(0.0)))


def event_indicators(df: DataFrame, by: list[str], order: list[str], kind: str, value: str, other: str | None = None, bound: float = 3.5) -> DataFrame:
    """Six indicators of a channel, its timestamps and a second channel, one row a trajectory; without that, C18 is NULL.

    Equal to :mod:`timeseries`' single operators, but fused: one sorted window gives all differences, and three
    aggregates on the same key follow (centres, deviations from them, shares), so rows are shuffled once.
    """
    w = W.partitionBy(*by).orderBy(*order)
    v, (a, b, d) = F.col(value), [F.lag(value, i).over(w) for i in (1, 2, 3)]
    steps = df.select(
        *by, v.alias("v"), F.row_number().over(w).alias("i"), (F.col(order[0]) - F.lag(order[0]).over(w)).cast("double").alias("dt"),
        (v - F.avg(v).over(W.partitionBy(*by))).alias("c"), (v - 2 * a + b).alias("d2"), F.col(other).alias("o") if other else F.lit(None).cast("double").alias("o"),
        F.abs(v - a).alias("s1"), F.abs(v - 2 * a + b).alias("s2"), F.abs(v - 3 * a + 3 * b - d).alias("s3"),
    )
    signals = ("s1", "s2", "s3")
    centres = steps.groupBy(*by).agg(
        F.count("*").alias("n"), quantile("v", [0.333, 0.667]).alias("q"), quantile(F.when(F.col("dt") > 0, F.col("dt")), 0.5).alias("mt"),
        *[x for s in signals for x in (quantile(s, 0.5).alias(f"m_{s}"), F.avg(s).alias(f"a_{s}"), F.stddev_pop(s).alias(f"p_{s}"))],
    )
    steps = steps.join(centres, by)
    steps = steps.join(steps.groupBy(*by).agg(*[quantile(F.abs(F.col(s) - F.col(f"m_{s}")), 0.5).alias(f"d_{s}") for s in signals]), by)

    def far(s: str):
        x, m, a, p, d = (F.col(f"{k}{s}") for k in ("", "m_", "a_", "p_", "d_"))
        z = F.when(d > 1e-12, 0.6745 * (x - m) / d).when(p > 1e-12, (x - a) / p)
        return F.coalesce(F.abs(z) > bound, F.lit(False))

    share = lambda cond: F.avg(cond.cast("double"))
    low, high, later = F.col("v") <= F.col("q")[0], F.col("v") > F.col("q")[1], F.col("i") > 1
    entropy = lambda r: F.when(r > 0, -r * F.ln(r)).otherwise(F.lit(0.0))
    long = F.max("n") >= 4
    energy, second = F.coalesce(F.sum(F.col("c") * F.col("c")), F.lit(0.0)), F.coalesce(F.sum(F.col("d2") * F.col("d2")), F.lit(0.0))
    rises = F.col("dt") > 0
    steady = rises & F.coalesce(F.col("dt") <= 3 * F.col("mt"), F.lit(False))
    found = steps.groupBy(*by).agg(
        F.when(long, 1 - F.avg(F.when(later, (far("s1") | far("s2") | far("s3")).cast("double")))).alias("C8_anomaly"),
        F.when(~long, None).when(energy <= 1e-12, F.lit(1.0)).otherwise(1 - second / F.nullif(second + energy, F.lit(0.0))).alias("C10_noise"),
        F.when(F.max("n") < 2, None).when(F.max("mt").isNull(), F.lit(0.0)).otherwise((share(rises) + F.avg(F.when(F.col("dt").isNotNull(), steady.cast("double")))) / 2).alias("C11_timestamps"),
        ((entropy(share(low)) + entropy(share(~low & ~high)) + entropy(share(high))) / F.ln(F.lit(3.0))).alias("C14_skill"),
        F.when(F.max("n") >= 3, F.abs(safe_corr("v", "o"))).alias("C18_coordination"),
    )
    return found.join(S.category_entropy(df, kind, by).withColumnRenamed("entropy", "C12_scene_entropy"), by, "left")


def mode_rarity(df: DataFrame, columns: list[str], id_col: str, seed: int) -> DataFrame:
    """C15: k-means with k = min(4, max(1, floor(sqrt n))) on imputed columns; 1 - the cluster's share; 0 if k is 1."""
    n = df.count()
    k = min(4, max(1, int(n**0.5)))
    filled = models.impute_median(df, columns, 0.0)
    if k <= 1:
        return filled.withColumns({"cluster": F.lit(0), "rarity": F.lit(0.0)})
    found = models.k_means(filled, columns, k, seed, id_col)
    shares = found.groupBy("cluster").agg((1 - F.count("*") / F.lit(float(n))).alias("rarity"))
    return found.join(F.broadcast(shares), "cluster")  # at most four rows


def uniqueness(df: DataFrame, id_col: str, vector: str, block: int = 2000) -> DataFrame:
    """C19: distance to the nearest other row, of z-scored vectors (ddof 1, constant: divisor 1), over the largest one; 0 without another row.

    Exact, by the pivot index of :mod:`neighbours`; ``block`` bounds its tiles.
    """
    if not df.limit(1).count():
        return df.select(F.col(id_col), F.lit(None).cast("double").alias("uniqueness"))
    return neighbours.uniqueness(df, id_col, vector, block)


def visual_joint_information(frames: DataFrame, by: list[str], camera: str, brightness: str, motion: str, bins: int = 5, least: int = 5) -> DataFrame:
    """C17: mean over cameras of the mutual information of binned brightness and motion; cameras with too few frames or a constant don't count."""
    rows = frames.where(F.col(brightness).isNotNull() & F.col(motion).isNotNull())
    fit = rows.groupBy(*by, camera).agg(F.count("*").alias("n"), F.stddev_pop(brightness).alias("s1"), F.stddev_pop(motion).alias("s2"))
    rows = rows.join(fit.where((F.col("n") >= least) & (F.col("s1") > 1e-12) & (F.col("s2") > 1e-12)).select(*by, camera), [*by, camera], "left_semi")
    binned = S.quantile_bins(S.quantile_bins(rows, [*by, camera], brightness, bins, "_a"), [*by, camera], motion, bins, "_b")
    return S.mutual_information(binned, [*by, camera], "_a", "_b").groupBy(*by).agg(F.avg("nmi").alias("C17"))


def pca_robustness(df: DataFrame, columns: list[str] | str, score: str, target: float = 0.9) -> DataFrame:
    """(component, evr, cum_evr, spearman): components up to ``target`` variance against the score, and their mixture.

    ``columns``: numeric columns, or the name of one array column, of any width. Each component's projection is scaled to
    0-1, turned to agree with the score, and mixed by explained variance (component 0 is the mixture). Rows that miss a
    column or the score don't count.

    The Gram matrix is added up by blocks, projections are made once and stored, and all components are ranked as one
    long table. Scaling and turning keep or reverse an order, so the mixture is one weighted sum of projections.
    """
    spark, kind = df.sparkSession, "component int, evr double, cum_evr double, spearman double"
    vector = F.col(columns).cast("array<double>") if isinstance(columns, str) else F.array(*[F.col(c).cast("double") for c in columns])
    rows = df.select(F.col(score).cast("double").alias("y"), vector.alias("v")).where(F.col("y").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    n, s, p = models.vector_gram(rows, "v")
    if not n:
        return spark.createDataFrame([], kind)
    mean, load, evr = models.principal_axes(n, s, p)
    cum = np.cumsum(evr)
    k = min(int(np.searchsorted(cum, target)) + 1, len(evr))
    made = scratch(models.vector_projection(rows, "v", mean, load[:k], "v"), "projections")
    made = scratch(S.average_rank(made, "y", [], "ry"), "projections-ranked")
    long = made.select("ry", F.posexplode("v").alias("i", "x"))
    ends = {r["i"]: r["hi"] - r["lo"] for r in long.groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}  # one row a component
    ranked = S.average_rank(long, "x", ["i"], "rx")
    rho = {r["i"]: r["rho"] or 0.0 for r in ranked.groupBy("i").agg(safe_corr("rx", "ry").alias("rho")).collect()}
    share = evr[:k] / max(evr[:k].sum(), 1e-300)
    slope = [float(share[i] * (1 if rho[i] >= 0 else -1) / ends[i]) if ends[i] > S.EPS else 0.0 for i in range(k)]
    mixed = F.aggregate(F.zip_with("v", F.lit(slope), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    total = S.average_rank(made.select("ry", mixed.alias("x")), "x", [], "rx").agg(safe_corr("rx", "ry").alias("rho")).first()["rho"]
    out = [(0, 1.0, 1.0, total), *[(i + 1, float(evr[i]), float(cum[i]), abs(rho[i])) for i in range(k)]]
    return spark.createDataFrame(out, kind)
