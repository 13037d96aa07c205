"""Normalisation, entropy weights, composite scores, rank statistics and information measures.

Table-wide figures (minima, sums, thresholds) are one-row aggregates joined back by a broadcast of that one row; no
value passes through the driver and no window spans the whole table.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinetrail.functions.columns import clip, quantile, safe_corr
from kinetrail.operators.order import running, table_quantiles
from kinetrail.sources.store import scratch

EPS = 1e-12


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` with the columns of a one-row aggregate."""
    return df.crossJoin(F.broadcast(one_row))


def per_group(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    return df.join(groups, by) if by else beside(df, groups)


def minmax(df: DataFrame, columns: dict[str, int], by: list[str] | None = None) -> DataFrame:
    """Columns scaled to [0, 1] (direction -1: turned round), within ``by`` groups or the whole table.

    Without any value 0.5; constant 1.0; missing values get the mean of the scaled ones.
    """
    by = by or []
    aggs = [f(F.col(x).cast("double")).alias(f"_{x}_{n}") for x in columns for n, f in (("lo", F.min), ("hi", F.max))]
    df = per_group(df, df.groupBy(*by).agg(*aggs), by)
    scaled = {}
    for x, sign in columns.items():
        lo, hi = F.col(f"_{x}_lo"), F.col(f"_{x}_hi")
        v = (F.col(x) - lo) / F.nullif(hi - lo, F.lit(0.0))
        scaled[x] = F.when(lo.isNull(), F.lit(0.5)).when(hi - lo <= EPS, F.lit(1.0)).otherwise(v if sign > 0 else 1 - v)
    df = df.withColumns(scaled).drop(*[f"_{x}_{n}" for x in columns for n in ("lo", "hi")])
    means = df.groupBy(*by).agg(*[F.avg(x).alias(f"_{x}_m") for x in columns])
    df = per_group(df, means, by)
    return df.withColumns({x: clip(F.coalesce(F.col(x), F.col(f"_{x}_m"), F.lit(0.5))) for x in columns}).drop(*[f"_{x}_m" for x in columns])


def entropy_weights(df: DataFrame, columns: list[str]) -> DataFrame:
    """(indicator, weight, entropy, divergence) from scaled columns: what tells rows apart weighs more."""
    long = df.unpivot([], columns, "indicator", "x").withColumn("x", F.coalesce(F.col("x").cast("double"), F.lit(0.0)))
    sums = long.groupBy("indicator").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    long = long.join(F.broadcast(sums), "indicator")  # one row an indicator
    p = F.when(F.col("s") > EPS, F.col("x") / F.nullif(F.col("s"), F.lit(0.0))).otherwise(1.0 / F.col("n"))
    k = 1 / F.ln(F.greatest(F.max("n"), F.lit(2)).cast("double"))
    e = long.withColumn("p", p).groupBy("indicator").agg((-k * F.sum(F.col("p") * F.ln(F.col("p") + EPS))).alias("entropy"))
    e = e.withColumn("divergence", 1 - F.col("entropy"))
    total = e.agg(F.sum("divergence").alias("_t"), F.count("*").alias("_k"))
    weight = F.when(F.col("_t") <= EPS, 1.0 / F.col("_k")).otherwise(F.col("divergence") / F.nullif(F.col("_t"), F.lit(0.0)))
    return beside(e, total).select("indicator", weight.alias("weight"), "entropy", "divergence")


def composite_scores(df: DataFrame, keys: list[str], weights: DataFrame, dimensions: dict[str, list[str]]) -> DataFrame:
    """keys, Q_score and Q_<dimension>: weighted sums; a dimension without weight takes the plain mean."""
    columns = sorted({x for xs in dimensions.values() for x in xs})
    wide = weights.agg(*[F.max(F.when(F.col("indicator") == x, F.col("weight"))).alias(f"_w_{x}") for x in columns])
    df = beside(df, wide)
    w = {x: F.coalesce(F.col(f"_w_{x}"), F.lit(0.0)) for x in columns}
    total = lambda xs: sum((F.col(x) * w[x] for x in xs), F.lit(0.0))
    out = [total(columns).alias("Q_score")]
    for name, xs in dimensions.items():
        mass = sum((w[x] for x in xs), F.lit(0.0))
        mean = sum((F.col(x) for x in xs), F.lit(0.0)) / len(xs)
        out.append(F.when(mass <= EPS, mean).otherwise(total(xs) / F.nullif(mass, F.lit(0.0))).alias(f"Q_{name}"))
    return df.select(*keys, *out)


def zscore(df: DataFrame, columns: list[str], suffix: str = "_z", fit_on: Column | None = None) -> DataFrame:
    """z-scores (ddof 0) over the table, or over the rows where ``fit_on`` holds; 0 where the spread is nil."""
    of = lambda x: F.when(fit_on, F.col(x)) if fit_on is not None else F.col(x)
    stats = df.agg(*[f(of(x)).alias(f"_{x}_{n}") for x in columns for n, f in (("a", F.avg), ("s", F.stddev_pop))])
    df = beside(df, stats)
    z = {f"{x}{suffix}": F.when(F.col(f"_{x}_s") < EPS, F.lit(0.0)).otherwise((F.col(x) - F.col(f"_{x}_a")) / F.nullif(F.col(f"_{x}_s"), F.lit(0.0))) for x in columns}
    return df.withColumns(z).drop(*[f"_{x}_{n}" for x in columns for n in ("a", "s")])


def unit_scale(df: DataFrame, column: str, into: str) -> DataFrame:
    """0-1 scaling for charts: a constant column gives 0 (unlike :func:`minmax`)."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    v = (F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return beside(df, ends).withColumn(into, F.when(F.col("_hi") - F.col("_lo") <= EPS, F.lit(0.0)).otherwise(v)).drop("_lo", "_hi")


def value_tiers(df: DataFrame, column: str) -> DataFrame:
    """``tier``: high from the upper tercile on, mid from the lower one on, else low."""
    low, high = table_quantiles(df, {column: [1 / 3, 2 / 3]})[column]
    return df.withColumn("tier", F.when(F.col(column) >= F.lit(high), "high").when(F.col(column) >= F.lit(low), "mid").otherwise("low"))


def dual_score(a: str, b: str, share: float = 0.5) -> Column:
    """Two scores weighted ``share`` and 1 - ``share``; NULL if either is."""
    return F.col(a) * share + F.col(b) * (1 - share)


def average_rank(df: DataFrame, column: str, by: list[str], into: str) -> DataFrame:
    """Ranks from 1 with the mean rank for ties.

    Counts per distinct value are added up, so ties never make a window grow, slice by slice, so large groups don't either.
    ``df`` is read twice and met by value: a column that is computed anew each time (a mean of doubles, whose last bit
    follows the order of its rows) has to be stored first.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    ranks = running(counts, by, [F.col(column)], {"_n": "_upto"})
    ranks = ranks.select(*by, column, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(into))
    return df.join(ranks, [*by, column], "left")


def correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, n, pearson, spearman) of each feature with the target over rows that have both."""
    df = scratch(df.select(*dict.fromkeys([*features, target])), "correlated")  # ranks are met by value: these must not change in between
    long = df.unpivot([target], features, "feature", "x").where(F.col("x").isNotNull() & F.col(target).isNotNull())
    long = average_rank(average_rank(long, "x", ["feature"], "_rx"), target, ["feature"], "_ry")
    return long.groupBy("feature").agg(F.count("*").alias("n"), safe_corr("x", target).alias("pearson"), safe_corr("_rx", "_ry").alias("spearman"))


def spearman_p(corr: str | Column, n: str | Column) -> Column:
    """Two-sided p-value of a rank correlation by the normal tail of its t statistic; NULL under 3 rows.

    The tail is the classical rational approximation (absolute error under 1.5e-7).
    """
    r = clip(F.col(corr) if isinstance(corr, str) else corr, -0.999999, 0.999999)
    n = F.col(n) if isinstance(n, str) else n
    x = F.abs(r * F.sqrt((n - 2) / (1 - r * r))) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    # fixed values: coefficients of the published approximation of the error function
    poly = sum(F.lit(a) * t**i for i, a in enumerate((0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429), 1))
    return F.when(n >= 3, poly * F.exp(-x * x))


def _beta_share(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function for x in [0, 1], by its continued fraction (modified Lentz)."""
    turned = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    log = np.array([math.lgamma(u + v) - math.lgamma(u) - math.lgamma(v) for u, v in zip(p, q)])
    with np.errstate(divide="ignore"):
        front = np.exp(log + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    share = np.where(z <= 0, 0.0, front * h)
    return np.where(turned, 1 - share, share)


def student_p(corr: str | Column, n: str | Column) -> Column:
    """Two-sided p-value of a correlation of ``n`` rows by the t distribution with n - 2 degrees of freedom; NULL under 3 rows.

    A correlation of 1 or -1 has p = 0. Exact to about 1e-12, in Arrow batches.
    """

    @F.pandas_udf("double")
    def tail(r: pd.Series, k: pd.Series) -> pd.Series:
        r, k = r.to_numpy(float), k.to_numpy(float)
        out = np.full(len(r), np.nan)
        ok = ~np.isnan(r) & (k >= 3)
        out[ok] = _beta_share((k[ok] - 2) / 2, 0.5, np.clip(1 - r[ok] ** 2, 0, 1))
        return pd.Series(out)

    p = tail(F.col(corr).cast("double") if isinstance(corr, str) else corr, F.col(n).cast("double") if isinstance(n, str) else n)
    return F.when(~F.isnan(p), p)


def category_entropy(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Entropy of a column's values over ln(number of values), natural logarithm."""
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    p = F.col("n") / F.col("t")
    parts = per_group(counts, totals, by).withColumn("e", -p * F.ln(p + EPS))
    return parts.groupBy(*by).agg((F.sum("e") / F.ln(F.greatest(F.max("k"), F.lit(2)).cast("double"))).alias("entropy"))


def quantile_bins(df: DataFrame, by: list[str], column: str, n: int, into: str) -> DataFrame:
    """Bins by the group's inner quantiles (a value on an edge is in the upper bin; equal edges merge); constant: 0."""
    cuts = df.groupBy(*by).agg(F.array_distinct(quantile(column, [i / n for i in range(1, n)])).alias("_q"), (F.max(column) - F.min(column)).alias("_r"))
    bins = F.size(F.filter("_q", lambda e: F.col(column) >= e))
    return per_group(df, cuts, by).withColumn(into, F.when(F.col("_r") <= EPS, F.lit(0)).otherwise(bins)).drop("_q", "_r")


def mutual_information(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Normalised mutual information of two discrete columns (mean of entropies below; nil entropy gives 0)."""
    cells = df.groupBy(*by, a, b).agg(F.count("*").alias("n"))
    w = W.partitionBy(*by)
    cells = cells.withColumns({"na": F.sum("n").over(W.partitionBy(*by, a)), "nb": F.sum("n").over(W.partitionBy(*by, b)), "t": F.sum("n").over(w)})
    p, pa, pb = (F.col(x) / F.col("t") for x in ("n", "na", "nb"))
    share_a, share_b = F.col("n") / F.col("na"), F.col("n") / F.col("nb")
    parts = cells.groupBy(*by).agg(F.sum(p * F.ln(p / (pa * pb))).alias("mi"), F.sum(-pa * F.ln(pa) * share_a).alias("ha"), F.sum(-pb * F.ln(pb) * share_b).alias("hb"))
    half = (F.col("ha") + F.col("hb")) / 2
    return parts.select(*by, F.when(half <= EPS, F.lit(0.0)).otherwise(clip(F.col("mi") / F.nullif(half, F.lit(0.0)))).alias("nmi"))


def regression_metrics(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """n, mae, rmse, r2, pearson per group; r2 is NULL for a constant target."""
    e = F.col(p) - F.col(y)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(F.var_pop(y) > EPS, 1 - F.avg(e * e) / F.nullif(F.var_pop(y), F.lit(0.0))).alias("r2"),
        safe_corr(y, p).alias("pearson"),
    )


def prediction_metrics(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """:func:`regression_metrics` and the rank correlation of prediction and target, per group; rows that miss either don't count."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).withColumns({"_y": F.col(y).cast("double"), "_p": F.col(p).cast("double")})
    rows = scratch(rows.select(*by, "_y", "_p"), "predictions")
    ranked = average_rank(average_rank(rows, "_y", by, "_ry"), "_p", by, "_rp")
    rho = ranked.groupBy(*by).agg(safe_corr("_ry", "_rp").alias("spearman"))
    return per_group(regression_metrics(rows, by, "_y", "_p"), rho, by)


def fold_summary(metrics: DataFrame, by: list[str], fold: str, columns: list[str]) -> DataFrame:
    """Metrics of folds -> by ``by``: folds, and each metric's mean and deviation (ddof 1; NULL for one fold); a metric that is NULL in a fold doesn't count."""
    figures = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return metrics.groupBy(*by).agg(F.countDistinct(fold).alias("n_folds"), *figures)


def channel_coordination(df: DataFrame, by: list[str], channels: list[str]) -> DataFrame:
    """Mean |Pearson| over pairs of channels; pairs with a constant channel don't count."""
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i + 1 :]]
    found = df.groupBy(*by).agg(*[F.abs(safe_corr(a, b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    kept = F.array_compact(F.array(*[F.col(f"_{i}") for i in range(len(pairs))]))
    return found.select(*by, F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept)).alias("coordination"))


def low_variance(df: DataFrame, features: list[str], dominant: float = 0.995) -> DataFrame:
    """(feature, n_distinct, dominant_ratio, std, verdict); missing values are a value of their own for the ratio."""
    long = df.unpivot([], features, "feature", "x")
    counts = long.groupBy("feature", "x").agg(F.count("*").alias("n"))
    shape = counts.groupBy("feature").agg(F.count("x").alias("n_distinct"), (F.max("n") / F.sum("n")).alias("dominant_ratio"))
    spread = long.groupBy("feature").agg(F.stddev_pop("x").alias("std"))
    verdict = F.when(F.col("n_distinct") == 0, "all_missing").when(F.col("n_distinct") == 1, "constant").when(F.col("dominant_ratio") >= dominant, "quasi_constant").when(F.col("std") < EPS, "low_std").otherwise("keep")
    return shape.join(spread, "feature").withColumn("verdict", verdict)
