"""Small models: ridge by normal equations, weighted logistic regression, PCA, k-means, a small network.

What has a closed form is solved from aggregates (Gram matrices of a few columns), so data stay distributed and only
k x k numbers reach the driver. :mod:`training` trains networks over partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.operators.order import table_quantiles
from kinetrail.operators.training import added, vectors
from kinetrail.sources.store import scratch


def impute_median(df: DataFrame, columns: list[str], else_value: float | None = None) -> DataFrame:
    """Missing values become the column's exact median (interpolated), or ``else_value`` if there is no value at all."""
    gaps = df.agg(F.lit(0), *[F.count_if(F.col(x).isNull()).alias(x) for x in columns]).first()
    gappy = {x: [0.5] for x in columns if gaps[x]}  # without a gap no median is needed
    mids = dict.fromkeys(columns, [None]) | (table_quantiles(df, gappy) if gappy else {})
    last = [F.lit(else_value)] if else_value is not None else []
    return df.withColumns({x: F.coalesce(F.col(x).cast("double"), F.lit(mids[x][0]).cast("double"), *last) for x in columns})


def gram(df: DataFrame, columns: list[str], weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, column sums, cross products) in one aggregate."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = [F.col(c).cast("double") for c in columns]
    k = len(x)
    cells = [F.sum(w).alias("n"), *[F.sum(w * a).alias(f"s{i}") for i, a in enumerate(x)]]
    cells += [F.sum(w * x[i] * x[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    row = df.agg(*cells).first()
    p = np.array([[row[f"p{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    return float(row["n"] or 0), np.array([row[f"s{i}"] or 0.0 for i in range(k)]), p


def ridge_from_gram(n: float, s: np.ndarray, p: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Ridge on standardised features (ddof 0), last column the target: (coefficients on raw features, intercept)."""
    mean = s / n
    cov = p / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    scale[scale < 1e-12] = 1.0
    z = cov[:-1, :-1] / np.outer(scale, scale)
    beta = np.linalg.solve(n * z + alpha * np.eye(len(scale)), n * cov[:-1, -1] / scale) / scale
    return beta, float(mean[-1] - beta @ mean[:-1])


def importance(df: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """(feature, coefficient, importance, rank): ridge on standardised features, largest absolute coefficient first.

    Rows that miss a feature or the target don't count. Only the Gram matrix reaches the driver.
    """
    cols = [*features, target]
    n, s, p = gram(df.dropna(subset=cols), cols)
    if not n:
        return df.sparkSession.createDataFrame([], "feature string, coefficient double, importance double, rank int")
    scale = np.sqrt(np.maximum(np.diag(p) / n - (s / n) ** 2, 0))[:-1]
    scale[scale < 1e-12] = 1.0
    beta = ridge_from_gram(n, s, p, alpha)[0] * scale
    order = sorted(range(len(features)), key=lambda i: (-abs(beta[i]), features[i]))
    return df.sparkSession.createDataFrame([(features[i], float(beta[i]), float(abs(beta[i])), r) for r, i in enumerate(order, 1)], "feature string, coefficient double, importance double, rank int")


def feature_configs(df: DataFrame, scores: list[str], quality: list[str], motion: list[str]) -> dict[str, list[str]]:
    """Nested feature lists: A scores, B scores and quality, C all; absent columns and constant quality columns are left out."""
    there = lambda names: [c for c in names if c in df.columns]
    own = there(quality)
    ends = df.agg(*[f(c).alias(f"{n}{c}") for c in own for n, f in (("lo_", F.min), ("hi_", F.max))]).first() if own else {}
    varied = [c for c in own if ends[f"lo_{c}"] is not None and ends[f"lo_{c}"] != ends[f"hi_{c}"]]
    a = there(scores)
    b = [*a, *[c for c in varied if c not in a]]
    return {"A": a, "B": b, "C": [*b, *[c for c in there(motion) if c not in b]]}


def ridge_folds(df: DataFrame, features: list[str], target: str, fold: str, alpha: float = 1.0) -> DataFrame:
    """``pred``: ridge trained on all rows outside the row's fold.

    One aggregate gives each fold's Gram matrix; a fold's training matrix is the total less its own, so nothing is
    trained by passing over rows again. The number of folds bounds what reaches the driver.
    """
    cols = [*features, target]
    x = [F.col(c).cast("double") for c in cols]
    k = len(x)
    cells = [F.count("*").alias("n"), *[F.sum(a).alias(f"s{i}") for i, a in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]]
    rows = df.groupBy(fold).agg(*cells).collect()
    parts = {}
    for r in rows:
        parts[r[fold]] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(k)]), np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]))
    total = [sum(x[i] for x in parts.values()) for i in range(3)]
    fits = []
    for f, own in parts.items():
        n, s, p = (t - o for t, o in zip(total, own))
        if n > 0:
            beta, b0 = ridge_from_gram(n, s, p, alpha)
            fits.append((f, [float(b) for b in beta], b0))
    kind = df.schema[fold].dataType.simpleString()
    models = df.sparkSession.createDataFrame(fits, f"_fold {kind}, _b array<double>, _b0 double")
    pred = sum((F.col(c).cast("double") * F.col("_b")[i] for i, c in enumerate(features)), F.col("_b0"))
    return df.join(F.broadcast(models), F.col(fold).eqNullSafe(F.col("_fold")), "left").withColumn("pred", pred).drop("_fold", "_b", "_b0")


def mean_baseline(df: DataFrame, target: str, fold: str) -> DataFrame:
    """``pred``: the mean of the target outside the row's fold, from sums alone."""
    sums = df.groupBy(fold).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    total = sums.agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    means = sums.crossJoin(F.broadcast(total)).select(fold, ((F.col("_ts") - F.col("_s")) / F.nullif(F.col("_tn") - F.col("_n"), F.lit(0))).alias("pred"))
    return df.join(means, fold)


def propensity(df: DataFrame, features: list[str], treated: str, low: float = 0.01, high: float = 0.99, c: float = 1.0, steps: int = 30) -> DataFrame:
    """``p``: balanced logistic regression on median-imputed, standardised features, clipped to [low, high].

    Newton's method; each step is one aggregate over the data (gradient and Hessian of a few columns).
    """
    filled = impute_median(df, features, 0.0)
    stats = filled.agg(*[f(x).alias(f"{n}_{x}") for x in features for n, f in (("a", F.avg), ("s", F.stddev_pop))], F.count("*").alias("n"), F.sum(treated).alias("n1")).first()
    n, n1 = stats["n"], float(stats["n1"] or 0)
    if not n or n1 in (0, n):
        raise ValueError("both arms need rows")
    z = [(F.col(x) - stats[f"a_{x}"]) / (stats[f"s_{x}"] if (stats[f"s_{x}"] or 0) > 1e-12 else 1.0) for x in features] + [F.lit(1.0)]
    weight = F.when(F.col(treated) == 1, n / (2 * n1)).otherwise(n / (2 * (n - n1)))
    k = len(z)
    beta = np.zeros(k)
    penalty = np.diag([1 / c] * (k - 1) + [0.0])
    score = lambda b: sum((a * float(v) for a, v in zip(z, b)), F.lit(0.0))
    rows = filled.select(treated, weight.alias("_w"), *[a.alias(f"_z{i}") for i, a in enumerate(z)]).cache()
    try:
        x = [F.col(f"_z{i}") for i in range(k)]
        for _ in range(steps):
            p = 1 / (1 + F.exp(-sum((a * float(v) for a, v in zip(x, beta)), F.lit(0.0))))
            r = rows.withColumn("_p", p)
            q = F.col("_w") * F.col("_p") * (1 - F.col("_p"))
            sums = r.agg(*[F.sum(F.col("_w") * (F.col("_p") - F.col(treated)) * x[i]).alias(f"g{i}") for i in range(k)], *[F.sum(q * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
            g = np.array([sums[f"g{i}"] for i in range(k)]) + penalty @ beta
            h = np.array([[sums[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + penalty
            step = np.linalg.solve(h + 1e-10 * np.eye(k), g)
            beta = beta - step
            if np.abs(step).max() < 1e-9:
                break
    finally:
        rows.unpersist()
    p = 1 / (1 + F.exp(-score(beta)))
    return filled.withColumn("p", F.least(F.greatest(p, F.lit(low)), F.lit(high)))


def pca(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, loadings as rows, explained variance ratios); each loading's sum is not negative."""
    return principal_axes(*gram(df, columns))


def vector_gram(df: DataFrame, vector: str, block: int = 256, fan_in: int = 16) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, sums, cross products) of an array column of any width; rows that are NULL or hold one don't count.

    Every task adds up its own Gram matrix and hands it on in square blocks. The blocks are added up by a tree: a group
    holds ``fan_in`` blocks of ``block`` squared numbers, however many tasks or dimensions there are.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if not width:
        return 0.0, np.zeros(0), np.zeros((0, 0))
    edges = [*range(0, width + 1, block), width + 1]  # one column more: the ones that count rows and sum columns

    def partial(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            x = np.hstack([x.reshape(batch.num_rows, width), np.ones((batch.num_rows, 1))])
            total += x.T @ x
        part = TaskContext.get().partitionId()
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            for j, (c, d) in enumerate(zip(edges[i:], edges[i + 1 :]), i):
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "cells": pa.array([total[a:b, c:d].tobytes()], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        cells = sum(np.frombuffer(x, float) for x in table.column("cells").to_pylist())
        return table.slice(0, 1).select(["part", "i", "j"]).append_column("cells", pa.array([cells.tobytes()], pa.binary()))

    kind = "part int, i int, j int, cells binary"
    level = scratch(rows.mapInArrow(partial, kind), "gram")
    parts = (level.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        level = level.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).groupBy("part", "i", "j").applyInArrow(merge, kind)
        parts = -(-parts // fan_in)
    total = np.zeros((width + 1, width + 1))
    for r in level.collect():  # the matrix itself
        (a, b), (c, d) = edges[r["i"] : r["i"] + 2], edges[r["j"] : r["j"] + 2]
        cells = np.frombuffer(bytes(r["cells"]), float).reshape(b - a, d - c)
        total[a:b, c:d] = cells
        total[c:d, a:b] = cells.T
    return float(total[-1, -1]), total[:-1, -1], total[:-1, :-1]


def principal_axes(n: float, s: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, loadings as rows, explained variance ratios), largest first; each loading's sum is not negative."""
    mean = s / max(n, 1)
    values, vectors = np.linalg.eigh(p / max(n, 1) - np.outer(mean, mean))
    order = np.argsort(values)[::-1]
    values, load = np.maximum(values[order], 0), vectors[:, order].T
    load = load * np.where(load.sum(1, keepdims=True) < 0, -1, 1)
    return mean, load, values / max(values.sum(), 1e-300)


def vector_projection(df: DataFrame, vector: str, mean: np.ndarray, load: np.ndarray, into: str) -> DataFrame:
    """``into``: the vector less ``mean`` on every row of ``load``; NULL for a vector that is NULL or holds one."""
    kept = [c for c in df.columns if c != into]
    v = F.col(vector).cast("array<double>")
    rows = df.select(*kept, F.when(~F.exists(v, lambda x: x.isNull()), v).alias(into))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            held = batch.column(len(kept))
            x = held.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean))
            flat = ((x - mean) @ load.T).reshape(-1)
            ends = np.append(0, np.cumsum(np.asarray(held.is_valid()))) * len(load)
            out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=held.is_null() if held.null_count else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], out], batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def project(columns: list[str], mean: np.ndarray, loading: np.ndarray):
    return sum(((F.col(c) - float(m)) * float(w) for c, m, w in zip(columns, mean, loading)), F.lit(0.0))


def k_means(df: DataFrame, columns: list[str], k: int, seed: int, id_col: str, rounds: int = 100) -> DataFrame:
    """``cluster``: Lloyd's rounds from k rows picked by a hash of the id; an empty cluster keeps its centre.

    Columns have no NULLs. Rows are stored once as vectors; a round is one pass that adds up clusters in Arrow batches,
    k vectors of sums a task.
    """
    width = len(columns)
    vector = F.array(*[F.col(c).cast("double") for c in columns])
    rows = scratch(df.select(vector.alias("x")), "k-means-rows")
    parts = (rows.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
    start = df.orderBy(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), id_col).limit(k).select(*columns).collect()
    centres = np.array([[float(v) for v in r] for r in start]).reshape(-1, width)

    def nearest(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.stack([((x - c) ** 2).sum(1) for c in at], 1).argmin(1)

    for _ in range(rounds):

        def work(b: pa.RecordBatch, at=centres) -> dict[int, np.ndarray]:
            x = vectors(b.column(0), width)
            near = nearest(x, at)
            return {int(i): np.append(x[near == i].sum(0), (near == i).sum()) for i in np.unique(near)}

        sums = added(rows, parts, len(centres), width + 1, work)
        new = np.where(sums[:, -1:] > 0, sums[:, :-1] / np.maximum(sums[:, -1:], 1), centres)
        if np.allclose(new, centres, atol=1e-12):
            break
        centres = new

    @F.pandas_udf("int")
    def cluster(x: pd.Series) -> pd.Series:
        return pd.Series(nearest(np.stack(x.to_numpy()), centres) if len(x) else [], dtype="int32")

    return df.withColumn("cluster", cluster(vector))


# --- A small network on arrays; what :mod:`training` does over partitions ------------------------------------------


def train_mlp(x: np.ndarray, y: np.ndarray, seed: int, hidden: int = 128, epochs: int = 35, batch: int = 8192, rate: float = 1e-3, decay: float = 1e-5) -> Callable[[np.ndarray], np.ndarray]:
    """Two hidden layers (linear, ReLU, layer norm) and a linear head; AdamW on squared error of standardised data."""
    rng = np.random.default_rng(seed)
    mx, sx, my, sy = x.mean(0), x.std(0), y.mean(0), y.std(0)
    sx[sx < 1e-8], sy[sy < 1e-8] = 1, 1
    a, b = (x - mx) / sx, (y - my) / sy
    sizes = [a.shape[1], hidden, hidden, b.shape[1]]
    w = [rng.uniform(-1, 1, (i, o)) / np.sqrt(i) for i, o in zip(sizes, sizes[1:])]
    params = [*w, *[np.zeros(o) for o in sizes[1:]], np.ones(hidden), np.ones(hidden), np.zeros(hidden), np.zeros(hidden)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def forward(z: np.ndarray):
        kept = []
        for i in range(2):
            r = np.maximum(z @ params[i] + params[3 + i], 0)
            mu, var = r.mean(1, keepdims=True), r.var(1, keepdims=True)
            inv = 1 / np.sqrt(var + 1e-5)
            h = (r - mu) * inv
            kept.append((z, r, h, inv))
            z = h * params[6 + i] + params[8 + i]
        return z @ params[2] + params[5], z, kept

    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(a))
        for at in np.split(order, range(batch, len(order), batch)):
            out, top, kept = forward(a[at])
            g = 2 * (out - b[at]) / out.size
            grads = [None] * len(params)
            grads[2], grads[5] = top.T @ g, g.sum(0)
            g = g @ params[2].T
            for i in (1, 0):
                z, r, h, inv = kept[i]
                grads[6 + i], grads[8 + i] = (g * h).sum(0), g.sum(0)
                d = g * params[6 + i]
                d = inv * (d - d.mean(1, keepdims=True) - h * (d * h).mean(1, keepdims=True)) * (r > 0)
                grads[i], grads[3 + i] = z.T @ d, d.sum(0)
                g = d @ params[i].T
            t += 1
            for j, q in enumerate(grads):
                m[j], v[j] = 0.9 * m[j] + 0.1 * q, 0.999 * v[j] + 0.001 * q * q
                params[j] = params[j] * (1 - rate * decay) - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return lambda q: forward((q - mx) / sx)[0] * sy + my
