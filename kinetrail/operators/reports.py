"""The tables behind the figures: ranks, extremes, box plots, roll-ups of effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinetrail.functions.columns import quantile


def rank_desc(df: DataFrame, value: str, into: str = "rank") -> DataFrame:
    """Rank from 1, largest first, ties share the smallest rank. For summary tables: one window over all rows."""
    return df.withColumn(into, F.rank().over(W.partitionBy(F.lit(0)).orderBy(F.desc_nulls_last(value))))


def extremes(df: DataFrame, value: str, id_col: str, n: int) -> DataFrame:
    """The n largest and n smallest rows, ``side`` top or bottom (two top-k plans)."""
    rows = df.where(F.col(value).isNotNull())
    top = rows.orderBy(F.desc(value), id_col).limit(n).withColumn("side", F.lit("top"))
    return top.unionByName(rows.orderBy(F.asc(value), id_col).limit(n).withColumn("side", F.lit("bottom")))


def boxplot(df: DataFrame, by: str, value: str, reach: float = 1.5) -> DataFrame:
    """(by, q1, median, q3, low, high): whiskers are the extreme values within ``reach`` interquartile ranges."""
    q = df.groupBy(by).agg(quantile(value, [0.25, 0.5, 0.75]).alias("_q"))
    rows = df.join(q, by).withColumn("_i", F.col("_q")[2] - F.col("_q")[0])
    inside = F.when((F.col(value) >= F.col("_q")[0] - reach * F.col("_i")) & (F.col(value) <= F.col("_q")[2] + reach * F.col("_i")), F.col(value))
    found = rows.groupBy(by).agg(F.min("_q").alias("_q"), F.min(inside).alias("low"), F.max(inside).alias("high"))
    return found.select(by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "low", "high")


def robustness(effects: DataFrame, by: list[str], threshold: str, att: str) -> DataFrame:
    """Over thresholds: number, mean effect and share of effects above 0."""
    return effects.groupBy(*by).agg(F.countDistinct(threshold).alias("n_thresholds"), F.avg(att).alias("mean_att"), F.avg((F.col(att) > 0).cast("double")).alias("positive_rate"))


def ablation_loss(summary: DataFrame, metric: str, ratio: float, full: str, ablated: list[str]) -> DataFrame:
    """(strategy, loss): how much less an ablated strategy reaches than the full one at a ratio, not below 0."""
    at = summary.where(F.abs(F.col("ratio") - ratio) <= 1e-8 + 1e-5 * abs(ratio))
    base = at.agg(F.max(F.when(F.col("strategy") == full, F.col(metric))).alias("_base"))
    return at.where(F.col("strategy").isin(ablated)).crossJoin(F.broadcast(base)).select("strategy", F.greatest(F.lit(0.0), F.col("_base") - F.col(metric)).alias("loss"))


def in_order(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows in the order of a list of names; others behind it."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))
    return df.orderBy(F.when(at == 0, len(names) + 1).otherwise(at), column)


def scatter(df: DataFrame, id_col: str, features: list[str], value: str) -> DataFrame:
    """(id, feature, x, value): points of each feature against ``value``; rows that miss either are left out."""
    long = df.select(id_col, value, *[F.col(x).cast("double").alias(x) for x in features]).unpivot([id_col, value], features, "feature", "x")
    return long.where(F.col("x").isNotNull() & F.col(value).isNotNull()).select(id_col, "feature", "x", value)


def first_seen(df: DataFrame, message: str, position: str) -> DataFrame:
    """(message, first_position, n): each distinct message once, with where it was first seen."""
    return df.groupBy(message).agg(F.min(position).alias("first_position"), F.count("*").alias("n"))
