"""Orders over whole tables without a task that holds them: running totals by slices, exact quantiles by brackets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinetrail.functions.columns import quantile
from kinetrail.sources.store import scratch

#: Values of a column that one task may hold.
MOST = 100_000


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with ``_place`` (from 1 within ``by``) and a running total ``sums[column]`` of each column in ``order``.

    Rows are range-partitioned by group and order, so a large group spans many slices; each slice adds up alone and
    starts from the totals of the slices before it (one row a group and slice). ``order`` should end in an id: rows
    that tie in all of it lie in one slice. NULLs add nothing to a total.
    """
    sums = sums or {}
    rows = scratch(df.repartitionByRange(*by, *order).withColumn("_slice", F.spark_partition_id()), "running")
    totals = rows.groupBy(*by, "_slice").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{into}") for c, into in sums.items()])
    before = W.partitionBy(*(by or [F.lit(0)])).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_slice").alias("_of"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in ["_n", *[f"_t_{into}" for into in sums.values()]]])
    same = F.col("_slice") == F.col("_of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    within = W.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumns({"_place": F.count("*").over(within)} | {into: F.coalesce(F.sum(c).over(within), F.lit(0)) for c, into in sums.items()}).join(base, same)
    found = found.withColumns({"_place": F.col("_place") + F.col("_b_n")} | {into: F.col(into) + F.col(f"_b_t_{into}") for into in sums.values()})
    return found.select(*df.columns, "_place", *sums.values())


def table_quantiles(df: DataFrame, wanted: dict[str, list[float]], most: int = MOST) -> dict[str, list[float | None]]:
    """Exact quantiles (linear interpolation) of whole columns; None for a column without values.

    Columns of at most ``most`` values are settled by one aggregate. In larger ones every rank that a quantile needs is
    held between two values by approximate quantiles, whose rank error is bounded; counts then tell whether the rank
    lies on one of the two or strictly between, and only what lies between is looked at in the next round (a
    thousandth of the rows or less). No task holds more than ``most`` values, whatever the ties.
    """
    columns = {c: F.col(c).cast("double") for c in wanted}
    counts = df.agg(*[F.count(x).alias(c) for c, x in columns.items()]).first()
    small = [c for c in wanted if counts[c] <= most]
    found: dict[str, list[float | None]] = {}
    if small:
        row = df.agg(*[quantile(c, wanted[c]).alias(c) for c in small]).first()
        found |= {c: list(row[c]) if row[c] is not None else [None] * len(wanted[c]) for c in small}
    large = [c for c in wanted if c not in small]
    if large:
        rows = scratch(df.select(*[columns[c].alias(c) for c in large]), "quantiles")
        for c in large:
            n, values = counts[c], {}
            at = [p * (n - 1) for p in wanted[c]]
            for k in sorted({f(x) for x in at for f in (math.floor, math.ceil)}):
                values[k] = _ranked(rows, c, k, n, most)
            found[c] = [values[math.floor(x)] + (values[math.ceil(x)] - values[math.floor(x)]) * (x - math.floor(x)) for x in at]
    return found


def _ranked(rows: DataFrame, column: str, k: int, n: int, most: int, accuracy: int = 10_000) -> float:
    """The k-th value (from 0) of a column of n values."""
    x, inside, first, size = F.col(column), rows.where(F.col(column).isNotNull()), 0, n
    while size > most:
        slack = 2 / accuracy
        at = (k - first) / size
        low, high = inside.agg(F.percentile_approx(x, F.array(F.lit(max(0.0, at - slack)), F.lit(min(1.0, at + slack))), accuracy).alias("q")).first()["q"]
        r = inside.agg(*[F.count_if(t).alias(a) for a, t in (("under", x < low), ("on_low", x == low), ("between", (x > low) & (x < high)))]).first()
        place = k - first - r["under"]
        if 0 <= place < r["on_low"]:
            return low
        place -= r["on_low"]
        if low < high and place == r["between"]:
            return high
        # a bracket that misses the rank (it doesn't by the bound on the error) is passed on to its other side, never trusted
        if place < 0:
            inside, size = inside.where(x < low), r["under"]
        elif place < r["between"]:
            inside, first, size = inside.where((x > low) & (x < high)), first + r["under"] + r["on_low"], r["between"]
        else:
            passed = r["under"] + r["on_low"] + r["between"]
            inside, first, size = inside.where(x >= high) if low < high else inside.where(x > low), first + passed, size - passed
            if low < high and k - first < (tied := inside.where(x == high).count()):
                return high
            if low < high:
                inside, first, size = inside.where(x > high), first + tied, size - tied
    return inside.agg(F.sort_array(F.collect_list(x))[k - first].alias("v")).first()["v"]


def group_quantiles(df: DataFrame, by: list[str], column: str, wanted: list[float], into: str = "quantiles", most: int = MOST, parts: int = 64, accuracy: int = 10_000) -> DataFrame:
    """(by, ``into``): exact quantiles (linear interpolation) of a column by group, an array in order of ``wanted``.

    Groups of at most ``most`` values are settled by one aggregate. For all larger ones together, every rank that is
    wanted is held between two values of a grid of approximate quantiles; counts tell where it lies, and only what lies
    between is looked at in the next round, about a twentieth. No task holds more than ``most`` values of a group,
    and a round is one pass for all groups. A group without a value has NULL; NULL values don't count; NULL keys are a group.
    """
    key = F.struct(*[F.col(c).alias(c) for c in by])
    rows = scratch(df.select(key.alias("g"), F.col(column).cast("double").alias("v")), "group-quantiles")
    counts = scratch(rows.groupBy("g").agg(F.count("v").alias("n")), "group-counts")
    few = rows.join(counts.where(F.col("n") <= most).select("g"), "g", "left_semi")
    small = few.groupBy("g").agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in wanted])).alias(into))
    large = counts.where(F.col("n") > most)
    if not large.limit(1).count():
        return small.select("g.*", into)
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in wanted]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
    none = F.lit(None).cast("double")
    todo = scratch(large.select("g", F.explode(ranks).alias("k")).join(large, "g").select("g", "k", F.col("k").alias("place"), F.col("n").alias("size"), none.alias("low"), none.alias("high")), "quantile-targets")
    big = scratch(rows.join(large.select("g"), "g", "left_semi").where("v is not null"), "large-groups")
    settled = todo.select("g", "k", none.alias("v")).limit(0)
    inside = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high")))
    while (wide := todo.where(F.col("size") > most)).limit(1).count():
        # targets with the same bracket share their passes
        marks = wide.select("g", "low", "high").distinct().withColumn("b", F.monotonically_increasing_id())
        marks = scratch(marks, "quantile-brackets")
        held = big.join(marks, "g").where(inside).select("b", "v")
        grid = held.groupBy("b").agg(F.percentile_approx("v", [i / parts for i in range(parts + 1)], accuracy).alias("grid"))
        named = [wide[c].eqNullSafe(marks[c]) for c in ("g", "low", "high")]
        near = wide.join(marks, named[0] & named[1] & named[2]).select(wide["g"], "k", "place", "size", wide["low"], wide["high"], "b").join(grid, "b")
        i = F.floor(F.col("place") / F.col("size") * parts).cast("int")
        near = near.withColumns({"x": F.element_at("grid", F.greatest(i, F.lit(1))), "y": F.element_at("grid", F.least(i + 3, F.lit(parts + 1)))}).drop("grid")
        near = scratch(near, "quantile-narrowed")
        ends = near.select("b", "x", "y").distinct()
        cut = held.join(ends, "b").groupBy("b", "x", "y").agg(*[F.count_if(t).alias(a) for a, t in (("under", F.col("v") < F.col("x")), ("on_x", F.col("v") == F.col("x")), ("between", (F.col("v") > F.col("x")) & (F.col("v") < F.col("y"))), ("on_y", (F.col("v") == F.col("y")) & (F.col("y") > F.col("x"))))])
        cut = near.join(cut, ["b", "x", "y"])
        place = F.col("place") - F.col("under")
        past = place - F.col("on_x")
        over = past - F.col("between")
        cut = cut.withColumn("found", F.when((place >= 0) & (past < 0), F.col("x")).when((over >= 0) & (over < F.col("on_y")), F.col("y")))
        done = cut.where("found is not null").select("g", "k", F.col("found").alias("v"))
        # a bracket that misses the rank is left on its other side, never trusted
        left = F.col("size") - F.col("under") - F.col("on_x") - F.col("between") - F.col("on_y")
        next_ = cut.where("found is null").select(
            "g", "k",
            F.when(place < 0, F.col("place")).when(over < 0, past).otherwise(over - F.col("on_y")).alias("place"),
            F.when(place < 0, F.col("under")).when(over < 0, F.col("between")).otherwise(left).alias("size"),
            F.when(place < 0, F.col("low")).when(over < 0, F.col("x")).otherwise(F.col("y")).alias("low"),
            F.when(place < 0, F.col("x")).when(over < 0, F.col("y")).otherwise(F.col("high")).alias("high"),
        )
        settled = scratch(settled.union(done), "quantiles-settled")
        todo = scratch(todo.where(F.col("size") <= most).union(next_), "quantile-targets")
    last = big.join(todo, "g").where(inside).groupBy("g", "k", "place").agg(F.sort_array(F.collect_list("v")).alias("_v"))
    values = settled.union(last.select("g", "k", F.element_at("_v", F.col("place").cast("int") + 1).alias("v")))
    table = values.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))  # two numbers a quantile
    found = table.join(large, "g")
    pick = [(F.col("m")[F.floor(x).cast("long")], F.col("m")[F.ceil(x).cast("long")], x - F.floor(x)) for x in at]
    big_ones = found.select("g", F.array(*[a + (b - a) * w for a, b, w in pick]).alias(into))
    return small.unionByName(big_ones).select("g.*", into)
