"""Treatments by quantile, propensity matching within scenes, effects with bootstrap intervals, balance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.functions.columns import NUMERIC, logit
from kinetrail.operators.order import table_quantiles
from kinetrail.operators.scoring import beside


def treatments(df: DataFrame, sources: list[str], quantiles: list[float]) -> DataFrame:
    """0/1 columns ``t_<source>_q<percent>``: at or over the quantile."""
    cuts = table_quantiles(df, {s: quantiles for s in sources})
    return df.withColumns({f"t_{s}_q{round(q * 100)}": (F.col(s) >= F.lit(cut).cast("double")).cast("int") for s in sources for q, cut in zip(quantiles, cuts[s])})


def confounders(df: DataFrame, candidates: list[str]) -> list[str]:
    """Those of the candidates that are numeric columns of ``df`` with at least one value (one aggregate)."""
    kinds = {f.name: f.dataType for f in df.schema}
    usable = [c for c in candidates if isinstance(kinds.get(c), NUMERIC)]
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in usable]).first() if usable else {}
    return [c for c in usable if counts[c]]


def balance(df: DataFrame, covariates: list[str], treated: str) -> DataFrame:
    """(covariate, smd): standardised mean differences between the arms."""
    long = df.unpivot([treated], covariates, "covariate", "x").where("x is not null")
    arm = lambda f, t: f(F.when(F.col(treated) == t, F.col("x")))
    pooled = F.sqrt(F.greatest((arm(F.var_samp, 1) + arm(F.var_samp, 0)) / 2, F.lit(1e-12)))
    return long.groupBy("covariate").agg(((arm(F.avg, 1) - arm(F.avg, 0)) / pooled).alias("smd"))


def balance_brief(found: DataFrame, by: list[str], good: float = 0.1) -> DataFrame:
    """By ``by``: covariates, mean ``abs_smd_before`` and ``abs_smd_after``, covariates with less than ``good`` after."""
    return found.groupBy(*by).agg(
        F.count("covariate").alias("n_covariates"),
        F.avg("abs_smd_before").alias("mean_abs_smd_before"),
        F.avg("abs_smd_after").alias("mean_abs_smd_after"),
        F.count_if(F.col("abs_smd_after") < good).alias("n_good_after"),
    )


def match_pairs(df: DataFrame, scene: str, id_col: str, treated: str, p: str = "p", caliper_ratio: float = 0.2) -> DataFrame:
    """(scene, treated_id, control_id, distance): greedy 1:1 nearest neighbours without replacement, within scenes.

    Treated rows are served in order of id; ties go to the smallest control id. The caliper is ``caliper_ratio``
    standard deviations (ddof 1) of all logits. Greedy serving is sequential by nature, so a scene is one group: it
    holds three numbers a row. Served controls are skipped by links to the next free one on either side, so a scene
    costs n log n; controls of one logit are served by id.
    """
    rows = df.select(F.col(scene).alias("scene"), F.col(id_col).alias("id"), F.col(treated).alias("t"), logit(p).alias("z"))
    rows = beside(rows, rows.agg((F.stddev_samp("z") * caliper_ratio).alias("caliper")))
    kind, scene_kind = df.schema[id_col].dataType.simpleString(), df.schema[scene].dataType.simpleString()

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        free = pdf[pdf["t"] == 0].sort_values(["z", "id"])
        z, ids, n = free["z"].to_numpy(), free["id"].to_numpy(), len(free)
        # places 1..n are controls, 0 and n + 1 the ends; a served place points on to its neighbour
        down, up = list(range(n + 2)), list(range(n + 2))

        def seek(links: list[int], i: int) -> int:
            while links[i] != i:
                links[i] = links[links[i]]
                i = links[i]
            return i

        # rows of one logit are sorted by id, so the first free one of them going up is their smallest id
        starts = np.searchsorted(z, z, "left") + 1
        for row in pdf[pdf["t"] == 1].sort_values("id").itertuples():
            at = int(np.searchsorted(z, row.z))
            under, over = seek(down, at), seek(up, at + 1)
            near = [(abs(z[i - 1] - row.z), seek(up, int(starts[i - 1]))) for i in (under, over) if 1 <= i <= n]
            if not near:
                break
            best, pick = min(near, key=lambda found: (found[0], ids[found[1] - 1]))
            if best <= row.caliper:
                out.append((row.scene, row.id, ids[pick - 1], best))
                down[pick], up[pick] = pick - 1, pick + 1
        return pd.DataFrame(out, columns=["scene", "treated_id", "control_id", "distance"])

    return rows.groupBy("scene").applyInPandas(greedy, f"scene {scene_kind}, treated_id {kind}, control_id {kind}, distance double")


def pair_outcomes(pairs: DataFrame, df: DataFrame, id_col: str, outcomes: list[str]) -> DataFrame:
    """(outcome, treated_id, diff): one matching serves all outcomes."""
    long = df.unpivot([id_col], outcomes, "outcome", "y")
    t = long.select(F.col(id_col).alias("treated_id"), "outcome", F.col("y").alias("yt"))
    k = long.select(F.col(id_col).alias("control_id"), "outcome", F.col("y").alias("yc"))
    return pairs.join(t, "treated_id").join(k, ["control_id", "outcome"]).select("outcome", "treated_id", (F.col("yt") - F.col("yc")).alias("diff"))


def effects(diffs: DataFrame, by: list[str], n_boot: int = 500, seed: int = 42) -> DataFrame:
    """(by, att, n_pairs, ci_low, ci_high): mean difference with a percentile bootstrap interval.

    Drawing with replacement needs the group's differences in one place; they are one number a pair.
    """
    kinds = ", ".join(f"{c} {diffs.schema[c].dataType.simpleString()}" for c in by)

    def boot(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("treated_id")["diff"].to_numpy()
        rng = np.random.RandomState(seed)
        means = [d[rng.randint(0, len(d), len(d))].mean() for _ in range(n_boot)]
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame([(*key, d.mean(), len(d), low, high)], columns=[*by, "att", "n_pairs", "ci_low", "ci_high"])

    return diffs.groupBy(*by).applyInPandas(boot, f"{kinds}, att double, n_pairs long, ci_low double, ci_high double")
