"""Effects of all treatments, groups of scenes and outcomes as one relation.

A cell is a treatment within a group of scenes. All cells' propensity models share the passes of one Newton loop, all
cells are matched in the same rounds, and effects, intervals and balance are grouped aggregates over cells; outcomes
share a cell's pairs. Only sums of a few columns and one row a cell reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.operators import causal, matching
from kinetrail.operators.order import table_quantiles
from kinetrail.operators.training import added, masks, vectors
from kinetrail.sources.store import scratch


@dataclass(frozen=True)
class Estimates:
    """cells: every cell with its status; pairs, effects and balance of those whose status is ok."""

    cells: DataFrame
    pairs: DataFrame
    effects: DataFrame
    balance: DataFrame


def estimate(
    df: DataFrame,
    id_col: str,
    scene: str,
    treatments: dict[str, str],
    covariates: list[str],
    outcomes: dict[str, int],
    groups: dict[str, list[str] | None],
    min_rows: int = 30,
    caliper_ratio: float = 0.2,
    n_boot: int = 500,
    seed: int = 42,
    steps: int = 30,
    low: float = 0.01,
    high: float = 0.99,
) -> Estimates:
    """``treatments``: 0/1 columns and the column each was cut from, which is none of its confounders. ``outcomes``: columns
    and whether more of them is better (1) or worse (-1). ``groups``: names and their scenes (None: all).

    A cell needs ``min_rows`` rows with the treatment known ("too_few_rows"), both arms ("one_arm") and a confounder with
    a value ("no_confounders"); others are reported with that status and not estimated. Missing covariates are filled by
    their median within the group. Effects: raw and turned so that more is better, with intervals; several rows of one
    id are one unit each only if ids differ, so ids must be unique.
    """
    spark = df.sparkSession
    names, kinds = list(treatments), list(groups)
    member = {g: F.lit(True) if scenes is None else F.col(scene).isin(*scenes) for g, scenes in groups.items()}
    arms = [F.count_if(member[g] & (F.col(t) == v)).alias(f"{i}_{j}_{v}") for i, t in enumerate(names) for j, g in enumerate(kinds) for v in (0, 1)]
    there = [F.count_if(member[g] & F.col(c).isNotNull()).alias(f"c{j}_{k}") for j, g in enumerate(kinds) for k, c in enumerate(covariates)]
    counts = df.agg(*arms, *there).first()
    fill: dict[str, list[float]] = {}
    spread: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for g in kinds:  # a handful of groups
        own = df.where(member[g])
        mids = table_quantiles(own, {c: [0.5] for c in covariates}) if covariates else {}
        fill[g] = [mids[c][0] if mids[c][0] is not None else 0.0 for c in covariates]
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in zip(covariates, fill[g])]
        row = own.agg(F.lit(0), *[f(x) for x in filled for f in (F.avg, F.stddev_pop)]).first()
        figures = np.array([v or 0.0 for v in row[1:]], float).reshape(-1, 2)
        spread[g] = figures[:, 0], np.where(figures[:, 1] > 1e-12, figures[:, 1], 1.0)

    cells, told = [], []
    for i, t in enumerate(names):
        for j, g in enumerate(kinds):
            n0, n1 = counts[f"{i}_{j}_0"], counts[f"{i}_{j}_1"]
            use = [k for k, c in enumerate(covariates) if c != treatments[t] and counts[f"c{j}_{k}"] > 0]
            status = "too_few_rows" if n0 + n1 < min_rows else "one_arm" if min(n0, n1) == 0 else "no_confounders" if not use else "ok"
            told.append((i * len(kinds) + j, t, g, n0 + n1, n1, [covariates[k] for k in use], status))
            if status == "ok":
                cells.append((i * len(kinds) + j, i, g, use, n0, n1))
    info = spark.createDataFrame(told, "cell int, treatment string, heterogeneity_group string, n_rows long, n_treated long, confounders array<string>, status string")
    id_kind, scene_kind = (df.schema[c].dataType.simpleString() for c in (id_col, scene))

    width = len(covariates)
    cell_of = {cell: (i, g, use, n0, n1) for cell, i, g, use, n0, n1 in cells}
    belongs = F.array_compact(F.array(*[F.when(member[g] & F.col(names[i]).isin(0, 1), F.lit(cell)) for cell, i, g, *_ in cells])) if cells else F.array().cast("array<int>")
    rows = df.select(F.array(*[F.col(c).cast("double") for c in covariates]).alias("x"), F.array(*[F.col(t).cast("double") for t in names]).alias("t"), belongs.alias("cells"), F.col(id_col).alias("id"), F.col(scene).alias("scene"))
    rows = scratch(rows.where(F.size("cells") > 0), "causal-rows")
    parts = (rows.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1

    def designed(x: np.ndarray, t: np.ndarray, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, g, use, n0, n1 = cell_of[cell]
        mean, sd = spread[g]
        z = np.where(np.isnan(x), np.array(fill[g]), x)
        z = np.hstack([((z - mean) / sd)[:, use], np.ones((len(x), 1))])
        y = t[:, i]
        return z, y, np.where(y == 1, (n0 + n1) / (2 * n1), (n0 + n1) / (2 * n0))

    beta = {cell: np.zeros(len(use) + 1) for cell, (_, _, use, _, _) in cell_of.items()}
    size, wanted = width + 1 + (width + 1) ** 2, set(cell_of)
    moving = set(wanted)
    for _ in range(steps if cells else 0):

        def work(b: pa.RecordBatch, beta=beta, moving=moving) -> dict[int, np.ndarray]:
            x, t, out = vectors(b.column(0), width), vectors(b.column(1), len(names)), {}
            for cell, at in masks(b.column(2), moving).items():
                z, y, w = designed(x[at], t[at], cell)
                p = 1 / (1 + np.exp(-(z @ beta[cell])))
                sums = np.zeros(size)
                g, h = z.T @ (w * (p - y)), (z * (w * p * (1 - p))[:, None]).T @ z
                sums[: len(g)], sums[width + 1 : width + 1 + h.size] = g, h.ravel()
                out[cell] = sums
            return out

        sums = added(rows.select("x", "t", "cells"), parts, len(names) * len(kinds), size, work)
        beta, still = dict(beta), set()
        for cell in moving:
            k = len(beta[cell])
            penalty = np.diag([1.0] * (k - 1) + [0.0])
            step = np.linalg.solve(sums[cell, width + 1 : width + 1 + k * k].reshape(k, k) + penalty + 1e-10 * np.eye(k), sums[cell, :k] + penalty @ beta[cell])
            beta[cell] = beta[cell] - step
            if np.abs(step).max() >= 1e-9:
                still.add(cell)
        moving = still
        if not moving:
            break

    def scores(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            x, t = vectors(b.column(0), width), vectors(b.column(1), len(names))
            for cell, at in masks(b.column(2), wanted).items():
                z, y, _ = designed(x[at], t[at], cell)
                p = np.clip(1 / (1 + np.exp(-(z @ beta[cell]))), low, high)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), cell), pa.int32()), b.column(3).take(take), b.column(4).take(take), pa.array(y.astype(np.int32)), pa.array(p)], ["cell", "id", "scene", "t", "p"])

    scored = scratch(rows.mapInArrow(scores, f"cell int, id {id_kind}, scene {scene_kind}, t int, p double"), "propensities")
    pairs = scratch(matching.closest_pairs(scored, "scene", "id", "t", "p", caliper_ratio, cell="cell"), "causal-pairs")

    # outcomes share the pairs
    long = df.unpivot([id_col], list(outcomes), "outcome", "y")
    t = long.select(F.col(id_col).alias("treated_id"), "outcome", F.col("y").alias("yt"))
    c = long.select(F.col(id_col).alias("control_id"), "outcome", F.col("y").alias("yc"))
    diffs = pairs.join(t, "treated_id").join(c, ["control_id", "outcome"]).select("cell", "outcome", "treated_id", (F.col("yt") - F.col("yc")).alias("diff"))
    found = matching.bootstrap_effects(diffs, ["cell", "outcome"], n_boot=n_boot, seed=seed)
    sign = F.element_at(F.create_map(*[F.lit(v) for o, s in outcomes.items() for v in (o, float(s))]), F.col("outcome"))
    turned = [(sign * F.col(c)) for c in ("att", "ci_low", "ci_high")]
    found = found.select("cell", "outcome", F.col("n_pairs").alias("n_treated_matched"), F.col("att").alias("att_raw"), turned[0].alias("att_beneficial_direction"), F.least(turned[1], turned[2]).alias("ci95_lo_beneficial"), F.greatest(turned[1], turned[2]).alias("ci95_hi_beneficial"))

    # balance before and after, all cells at once
    units = scored.join(df.select(F.col(id_col).alias("id"), *covariates), "id").drop("p", "scene")
    kept = pairs.select("cell", F.explode(F.array("treated_id", "control_id")).alias("id")).distinct()
    used = info.select("cell", F.explode("confounders").alias("covariate"))

    def smd(of: DataFrame, name: str) -> DataFrame:
        flat = of.unpivot(["cell", "t"], covariates, "covariate", "x").where("x is not null")
        arm = lambda f, v: f(F.when(F.col("t") == v, F.col("x")))
        pooled = F.sqrt(F.greatest((arm(F.var_samp, 1) + arm(F.var_samp, 0)) / 2, F.lit(1e-12)))
        return flat.groupBy("cell", "covariate").agg(((arm(F.avg, 1) - arm(F.avg, 0)) / pooled).alias(name))

    balance = smd(units, "smd_before").join(used, ["cell", "covariate"]).join(smd(units.join(kept, ["cell", "id"], "left_semi"), "smd_after"), ["cell", "covariate"], "left")
    balance = scratch(balance.withColumns({f"abs_{c}": F.abs(F.col(c)) for c in ("smd_before", "smd_after")}), "causal-balance")
    brief = causal.balance_brief(balance, ["cell"]).select("cell", "mean_abs_smd_before", "mean_abs_smd_after")
    told_of = info.select("cell", "treatment", "heterogeneity_group")
    return Estimates(info, told_of.join(pairs, "cell"), told_of.join(found, "cell").join(brief, "cell", "left"), told_of.join(balance, "cell"))


def robustness(effects: DataFrame) -> DataFrame:
    """By group, outcome and the treatment's quantile: estimates and mean effect and interval, in the beneficial direction."""
    tag: Column = F.nullif(F.regexp_extract("treatment", r"_q(\d+)$", 1), F.lit(""))
    means = {"att_beneficial_mean": "att_beneficial_direction", "ci95_lo_mean": "ci95_lo_beneficial", "ci95_hi_mean": "ci95_hi_beneficial"}
    return effects.groupBy("heterogeneity_group", "outcome", tag.alias("threshold_tag")).agg(F.count("att_beneficial_direction").alias("n_estimates"), *[F.avg(c).alias(n) for n, c in means.items()])
