"""Selections, splits, folds and curves. Ties are always broken by an id; random orders come from a hash of id and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinetrail.operators.order import running


def hash_order(id_col: str, seed: int) -> Column:
    """A random-looking but fixed order of ids: by the MD5 of id and seed."""
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def placed(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``df`` with ``_place`` (from 1 within the group) and ``_n`` (its rows), slice by slice: no task holds a group."""
    rows = running(df, [group], order)
    sizes = rows.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_n"))
    return rows.join(sizes, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def top_n(df: DataFrame, score: str, id_col: str, n: int, largest: bool = True) -> DataFrame:
    """The n best rows with a score and their ``selected_rank`` from 1 (a top-k plan, no full sort)."""
    order = [F.desc(score) if largest else F.asc(score), F.asc(id_col)]
    best = df.where(F.col(score).isNotNull()).orderBy(*order).limit(n)
    return best.withColumn("selected_rank", F.row_number().over(W.orderBy(*order)))


def top_share_per_group(df: DataFrame, group: str, score: str, id_col: str, ratio: float) -> DataFrame:
    """Of each group max(1, round(n ratio)) best rows; rounding half to even."""
    ranked = placed(df, group, [F.desc_nulls_last(score), F.asc(id_col)])
    return ranked.where(F.col("_place") <= F.greatest(F.lit(1).cast("long"), half_even(F.col("_n") * F.lit(ratio)))).drop("_place", "_n")


def random_n(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    return df.orderBy(hash_order(id_col, seed), id_col).limit(n)


def split_train(df: DataFrame, group: str, id_col: str, share: float, seed: int | None = None) -> DataFrame:
    """``split``: the first floor(n share) of each group train, the rest val; a group of one trains."""
    order = [hash_order(id_col, seed)] if seed is not None else []
    df = placed(df, group, [*order, F.col(id_col)])
    most = F.when(F.col("_n") == 1, F.lit(1).cast("long")).otherwise(F.least(F.greatest(F.floor(F.col("_n") * F.lit(share)), F.lit(1).cast("long")), F.col("_n") - 1))
    return df.withColumn("split", F.when(F.col("_place") <= most, "train").otherwise("val")).drop("_place", "_n")


def split_test_pool(df: DataFrame, group: str, id_col: str, share: float, seed: int | None = None) -> DataFrame:
    """``split``: max(1, round(n share)) of each group test, the rest pool."""
    order = [hash_order(id_col, seed)] if seed is not None else []
    df = placed(df, group, [*order, F.col(id_col)])
    n_test = F.greatest(F.lit(1).cast("long"), half_even(F.col("_n") * F.lit(share)))
    return df.withColumn("split", F.when(F.col("_place") <= n_test, "test").otherwise("pool")).drop("_place", "_n")


def k_folds(df: DataFrame, group: str | None, id_col: str, k: int, seed: int | None = None) -> DataFrame:
    """``fold`` from 0; per group with at most k folds (sizes differ by one, the first are larger).

    Without a group the folds cut the order of the whole table, placed slice by slice.
    """
    order = [hash_order(id_col, seed)] if seed is not None else []
    if group:
        rows = placed(df, group, [*order, F.col(id_col)])
    else:
        rows = running(df, [], [*order, F.col(id_col)]).withColumn("_n", F.lit(df.count()))
    size, more, at = F.floor(F.col("_n") / k), F.col("_n") % k, F.col("_place") - 1
    wide = (size + 1) * more
    fold = F.when(at < wide, F.floor(at / (size + 1))).otherwise(more + F.floor((at - wide) / F.greatest(size, F.lit(1))))
    return rows.withColumn("fold", fold.cast("int")).drop("_place", "_n")


def cumulative_mean(df: DataFrame, value: str, id_col: str, ascending: bool, by: list[str] | None = None) -> DataFrame:
    """``position`` and ``cum_mean`` of rows in order of value, NULLs last; large groups are added up slice by slice."""
    order = [F.asc_nulls_last(value) if ascending else F.desc_nulls_last(value), F.asc(id_col)]
    rows = df.withColumns({"_v": F.col(value).cast("double"), "_has": F.col(value).isNotNull().cast("long")})
    rows = running(rows, by or [], order, {"_v": "_sum", "_has": "_values"}).withColumnRenamed("_place", "position")
    return rows.withColumn("cum_mean", F.col("_sum") / F.nullif(F.col("_values"), F.lit(0))).drop("_v", "_has", "_sum", "_values")


def random_curve(df: DataFrame, value: str, id_col: str, ratios: list[float], repeats: int, seed: int = 42) -> DataFrame:
    """(ratio, n_repeats, mean, std): the mean ``value`` of random subsets, over ``repeats`` subsets of each ratio.

    A row is in a subset if a hash of id, seed and repeat falls below the ratio: nothing is sorted, rows are added up
    where they lie. Subset sizes vary around ratio x rows; a subset without a row has no mean and doesn't count.
    """
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(value).cast("double").alias("v")).where("v is not null")
    rows = rows.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    draw = F.conv(F.left(F.md5(F.concat_ws("|", "id", F.lit(str(seed)), F.col("repeat").cast("string"))), F.lit(8)), 16, 10).cast("long")
    per = rows.groupBy("repeat").agg(*[F.avg(F.when(draw < F.lit(float(r)) * 2**32, F.col("v"))).alias(str(i)) for i, r in enumerate(ratios)])
    long = per.select(F.explode(F.array(*[F.struct(F.lit(float(r)).alias("ratio"), F.col(str(i)).alias("m")) for i, r in enumerate(ratios)])).alias("_r")).select("_r.*")
    return long.groupBy("ratio").agg(F.count("m").alias("n_repeats"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"))


def curation_curve(df: DataFrame, score: str, value: str, id_col: str, ratios: list[float], by: str) -> DataFrame:
    """(by, ratio, n, mean, stderr) of ``value`` over the best ceil(ratio N) rows of each group."""
    ranked = placed(df, by, [F.desc(score), F.asc(id_col)])
    ranked = ranked.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    head = ranked.where(F.col("_place") <= F.greatest(F.lit(1).cast("long"), F.ceil(F.col("ratio") * F.col("_n"))))
    return head.groupBy(by, "ratio").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("stderr"))


def least_ratio(curve: DataFrame, by: str, share: float = 0.95, base_ratio: float = 1.0) -> DataFrame:
    """The smallest ratio whose mean reaches ``share`` of the mean at ``base_ratio``."""
    base = curve.groupBy(by).agg(F.max(F.when(F.abs(F.col("ratio") - base_ratio) < 1e-9, F.col("mean"))).alias("_base"))
    return curve.join(base, by).groupBy(by).agg(F.min(F.when(F.col("mean") >= share * F.col("_base"), F.col("ratio"))).alias("min_ratio"))
