"""Cross-validation of a ridge model with everything fitted on training folds only: feature drops, medians, scales, weights.

What a fold's training set needs are sums over the rows outside the fold, so all folds share their passes: counts of
values for the drops, quantiles by fold and feature for the medians, Gram matrices for the weights. The number of folds and
features bounds what reaches the driver; rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.operators import scoring
from kinetrail.operators.models import ridge_from_gram
from kinetrail.operators.order import group_quantiles
from kinetrail.operators.training import added, masks, vectors
from kinetrail.sources.store import scratch

VERDICTS = ["all_missing", "constant", "quasi_constant", "low_std"]


def fold_variances(df: DataFrame, features: list[str], fold: str, dominant: float = 0.995) -> DataFrame:
    """(fold, feature, n_distinct, dominant_ratio, std, verdict) over the rows outside each fold; as :func:`scoring.low_variance` judges a table.

    Values are counted once; a fold's training counts are the totals less its own.
    """
    long = df.unpivot([fold], features, "feature", "x").withColumnRenamed(fold, "_fold")
    own = scratch(long.groupBy("feature", "x", "_fold").agg(F.count("*").alias("c")), "value-counts")
    values = own.groupBy("feature", "x").agg(F.sum("c").alias("all"), F.map_from_entries(F.collect_list(F.struct(F.col("_fold").cast("string"), "c"))).alias("own"))  # one entry a fold
    folds = df.select(F.col(fold).alias("fold")).distinct()
    outside = values.crossJoin(F.broadcast(folds)).withColumn("c", F.col("all") - F.coalesce(F.col("own")[F.col("fold").cast("string")], F.lit(0))).where("c > 0")
    shape = outside.groupBy("fold", "feature").agg(F.count("x").alias("n_distinct"), (F.max("c") / F.sum("c")).alias("dominant_ratio"))
    # deviations from the table's mean keep the sums of squares small
    centre = long.groupBy("feature").agg(F.avg("x").alias("m"))
    part = outside.join(F.broadcast(centre), "feature").groupBy("fold", "feature").agg(
        F.sum(F.when(F.col("x").isNotNull(), F.col("c"))).alias("n"), F.sum(F.col("c") * (F.col("x") - F.col("m"))).alias("s"), F.sum(F.col("c") * (F.col("x") - F.col("m")) ** 2).alias("q")
    )
    std = F.sqrt(F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(0.0)))
    verdict = F.when(F.col("n_distinct") == 0, "all_missing").when(F.col("n_distinct") == 1, "constant").when(F.col("dominant_ratio") >= dominant, "quasi_constant").when(F.col("std") < 1e-12, "low_std").otherwise("keep")
    return shape.join(part.select("fold", "feature", std.alias("std")), ["fold", "feature"]).withColumn("verdict", verdict)


def cross_validate(df: DataFrame, keys: list[str], features: list[str], target: str, fold: str, alpha: float = 1.0, dominant: float = 0.995) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(predictions, folds, dropped) of a ridge model.

    predictions: keys, fold, y_true, y_pred, abs_error, of every row by the model of the other folds. folds: fold, n_train,
    n_test, n_features_used, n_features_dropped and the metrics on its rows. dropped: fold, feature, verdict. Rows without
    target or fold don't count; a missing feature is its training median. A fold whose training rows leave no feature
    predicts their mean target. One fold alone has no training rows and gives no predictions.
    """
    spark = df.sparkSession
    rows = df.where(F.col(target).isNotNull() & F.col(fold).isNotNull()).select(*keys, F.col(fold).alias("fold"), F.col(target).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in features])
    rows = scratch(rows, "cv-rows")
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}  # one row a fold
    names = sorted(sizes)
    judged = scratch(fold_variances(rows, features, "fold", dominant), "cv-variances")
    dropped = judged.where("verdict <> 'keep'").select("fold", "feature", "verdict")
    kept: dict = {f: [] for f in names}
    for r in judged.where("verdict = 'keep'").collect():  # folds x features
        kept[r["fold"]].append(features.index(r["feature"]))
    kept = {f: sorted(v) for f, v in kept.items()}
    # medians of the rows outside each fold
    others = F.filter(F.array(*[F.lit(f) for f in names]), lambda f: f != F.col("fold"))
    long = rows.withColumn("out", F.explode(others)).unpivot(["out"], features, "feature", "x").where("x is not null")
    medians = {(r["out"], r["feature"]): r["quantiles"][0] for r in group_quantiles(long, ["out", "feature"], "x", [0.5]).collect()}  # folds x features
    fill = {f: np.array([medians.get((f, c), 0.0) for c in features]) for f in names}

    number = F.array_position(F.array(*[F.lit(f) for f in names]), F.col("fold")).cast("int") - 1
    stored = rows.select(F.array(*features).alias("x"), F.array("y").alias("t"), F.filter(F.sequence(F.lit(0), F.lit(len(names) - 1)), lambda i: i != number).alias("train"), number.alias("k"), *[c for c in [*keys, "fold"]])
    stored = scratch(stored, "cv-arrays")
    width = len(features)
    parts = (stored.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1

    def design(x: np.ndarray, f) -> np.ndarray:
        return np.where(np.isnan(x), fill[f], x)[:, kept[f]]

    def work(b: pa.RecordBatch) -> dict[int, np.ndarray]:
        x, y, out = vectors(b.column(0), width), vectors(b.column(1), 1), {}
        for j, at in masks(b.column(2), set(range(len(names)))).items():
            m = np.hstack([design(x[at], names[j]), y[at], np.ones((len(at), 1))])
            g = np.zeros((width + 2, width + 2))
            g[: m.shape[1], : m.shape[1]] = m.T @ m
            out[j] = g.ravel()
        return out

    sums = added(stored.select("x", "t", "train"), parts, len(names), (width + 2) ** 2, work)
    fits = {}
    for j, f in enumerate(names):
        k = len(kept[f]) + 2
        g = sums[j].reshape(width + 2, width + 2)[:k, :k]
        n = float(g[-1, -1])
        if n:
            fits[j] = ridge_from_gram(n, g[:-1, -1], g[:-1, :-1], alpha) if k > 2 else (np.zeros(0), float(g[0, -1] / n))

    def predict(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            x, y, k = vectors(b.column(0), width), vectors(b.column(1), 1)[:, 0], b.column(2).to_numpy()
            out, known = np.zeros(len(x)), np.isin(k, list(fits))
            for j in np.unique(k[known]):
                at = k == j
                out[at] = design(x[at], names[j]) @ fits[j][0] + fits[j][1]
            batch = pa.RecordBatch.from_arrays([*b.columns[3:], pa.array(y), pa.array(out), pa.array(np.abs(out - y))], [*keys, "fold", "y_true", "y_pred", "abs_error"])
            yield batch.filter(pa.array(known))

    kinds = ", ".join(f"`{c}` {stored.schema[c].dataType.simpleString()}" for c in [*keys, "fold"])
    predictions = scratch(stored.select("x", "t", "k", *keys, "fold").mapInArrow(predict, f"{kinds}, y_true double, y_pred double, abs_error double"), "cv-predictions")
    fold_kind = rows.schema["fold"].dataType.simpleString()
    total = sum(sizes.values())
    told = spark.createDataFrame([(f, total - sizes[f], sizes[f], len(kept[f]), len(features) - len(kept[f])) for f in names], f"fold {fold_kind}, n_train long, n_test long, n_features_used int, n_features_dropped int")
    metrics = scoring.prediction_metrics(predictions, ["fold"], "y_true", "y_pred").drop("n")
    return predictions, told.join(metrics, "fold"), dropped


def cv_summary(folds: DataFrame, by: list[str]) -> DataFrame:
    """By ``by``: folds, mean features used, and mean and deviation over folds of the metrics."""
    used = folds.groupBy(*by).agg(F.sum("n_test").alias("n_samples"), F.avg("n_features_used").alias("n_features_used_mean"))
    return used.join(scoring.fold_summary(folds, by, "fold", ["mae", "rmse", "r2", "spearman", "pearson"]), by)
