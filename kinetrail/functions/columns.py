"""Column helpers with one rule for missing values: NULL only, never NaN.

Comparisons with a missing value are false, aggregates skip it, and a division by zero is missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` itself; raises if a column is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def numeric_columns(df: DataFrame, prefix: str = "", suffix: str = "", but: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name.startswith(prefix) and f.name.endswith(suffix) and f.name not in but]


def nan_to_null(df: DataFrame) -> DataFrame:
    """To be applied where data enters: floating NaN becomes NULL."""
    names = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names})


def to_number(x: str | Column) -> Column:
    """A double; what can't be read as one is NULL."""
    value = c(x).try_cast("double")
    return F.when(~F.isnan(value), value)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    """a / b within [0, 1]; NULL unless b > 0."""
    return clip(F.when(c(b) > 0, c(a) / c(b)))


def mean_of(*xs: str | Column) -> Column:
    """The mean of the values that aren't NULL."""
    kept = F.array_compact(F.array(*[c(x).cast("double") for x in xs]))
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept))


def non_blank(x: str | Column) -> Column:
    return F.coalesce(F.trim(c(x).cast("string")) != "", F.lit(False))


def share_present(*xs: str | Column) -> Column:
    """The share of fields that hold something besides blanks."""
    return reduce(lambda a, b: a + b, [non_blank(x).cast("double") for x in xs]) / len(xs)


def is_uuid(x: str | Column) -> Column:
    return c(x).rlike("^[0-9a-fA-F]{32}$")


def base_name(path: str | Column) -> Column:
    return F.element_at(F.split(c(path), "/"), -1)


def file_stem(path: str | Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]+$", "")


def is_archive(name: str | Column) -> Column:
    return F.lower(c(name)).rlike(r"\.(tar|tar\.gz|tgz|tar\.bz2|tbz2)$")


def safe_path(name: str | Column) -> Column:
    """An archive member's path without empty, ``.`` and ``..`` parts."""
    parts = F.split(F.replace(c(name), F.lit("\\"), F.lit("/")), "/")
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")


def sheet_name(x: str | Column) -> Column:
    """A legal worksheet name: no reserved characters, at most 31 long."""
    return F.left(F.trim(F.regexp_replace(c(x), r"[\\/*?:\[\]]", "_")), F.lit(31))


def unique_sheet_names(df: DataFrame, column: str, order: str, into: str = "sheet") -> DataFrame:
    """Legal worksheet names without repeats: from the second row of a name on (in ``order``) it ends in _1, _2, ... within 31 characters."""
    name = df.withColumn(into, sheet_name(column))
    again = F.row_number().over(W.partitionBy(into).orderBy(order)) - 1
    tail = F.concat(F.lit("_"), F.col("_again").cast("string"))
    return name.withColumn("_again", again).withColumn(into, F.when(F.col("_again") == 0, F.col(into)).otherwise(F.concat(F.left(F.col(into), 31 - F.length(tail)), tail))).drop("_again")


def text_of(content: str | Column) -> Column:
    """Bytes as text; NULL where they are no UTF-8."""
    return F.try_validate_utf8(c(content).cast("string"))


def global_id(scene: str | Column, trajectory: str | Column) -> Column:
    return F.concat(c(scene), F.lit("_"), c(trajectory))


def logit(p: str | Column, eps: float = 1e-6) -> Column:
    x = clip(c(p), eps, 1 - eps)
    return F.ln(x / (1 - x))


def close_to(a: str | Column, b, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return F.abs(c(a) - b) <= atol + rtol * F.abs(b)


def quantile_suffix(x: str | Column) -> Column:
    """The number in a name's ending ``_q<number>``; NULL without one."""
    return F.nullif(F.regexp_extract(c(x), r"_q(\d+)$", 1), F.lit("")).cast("int")


def reasons(checks: dict[str, Column], fine: str) -> Column:
    """Names of failed checks joined by ``|``; ``fine`` if all hold. A check on missing values fails."""
    failed = F.concat_ws("|", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return F.when(failed == "", F.lit(fine)).otherwise(failed)


def all_hold(checks: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(ok, F.lit(False)) for ok in checks.values()])


def sample_places(n: str | Column, most: int) -> Column:
    """0..n-1 if n <= ``most``; else ``most`` evenly spaced places, cut to whole numbers."""
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: (i * (c(n) - 1) / F.lit(float(max(1, most - 1)))).cast("int"))
    return F.when(c(n) <= 0, F.array().cast("array<int>")).when(c(n) <= most, F.sequence(F.lit(0), (c(n) - 1).cast("int"))).otherwise(even)


def quantile(x: str | Column, p) -> Column:
    """Exact quantiles with linear interpolation (an aggregate)."""
    return F.percentile(c(x).cast("double"), F.array(*[F.lit(float(v)) for v in p]) if isinstance(p, (list, tuple)) else F.lit(float(p)))


def safe_corr(x: str | Column, y: str | Column, eps: float = 1e-12) -> Column:
    """Pearson correlation (an aggregate) over rows that have both; NULL if either side is constant."""
    both = c(x).isNotNull() & c(y).isNotNull()
    x, y = F.when(both, c(x).cast("double")), F.when(both, c(y).cast("double"))
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > eps) & (sy > eps), F.covar_pop(x, y) / (sx * sy))


def to_int_seconds(ns: str | Column) -> Column:
    return c(ns) * F.lit(1e-9)


def mapped(x: str | Column, names: dict, default=None) -> Column:
    """The value a small dictionary gives for ``x``, else ``default``."""
    if not names:
        return F.lit(default)
    pairs = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return F.coalesce(pairs[c(x)], F.lit(default))


def depth_stats(pixels: str | Column) -> Column:
    """A depth frame's (mean, std, hole_ratio): mean and deviation (ddof 0) of pixels above 0, and the share of all others.

    Without a valid pixel mean and std are NULL; an empty or missing frame gives NULL throughout. NULL pixels are holes.
    """
    valid = F.transform(F.filter(c(pixels), lambda v: v > 0), lambda v: v.cast("double"))
    n = F.size(valid)
    mean = F.aggregate(valid, F.lit(0.0), lambda s, v: s + v) / F.nullif(n, F.lit(0))
    spread = F.aggregate(valid, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / F.nullif(n, F.lit(0))
    return F.when(F.size(c(pixels)) > 0, F.struct(mean.alias("mean"), F.sqrt(spread).alias("std"), (1 - n / F.size(c(pixels))).alias("hole_ratio")))
