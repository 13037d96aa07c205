"""Orders over whole tables, matching and small tables against NumPy and plain Python."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.functions import columns as C
from kinetrail.operators import causal, curation, models, order, quality, ranking, scoring
from kinetrail.sources.store import StageStore


@pytest.mark.parametrize("most", [40, 10_000])
def test_quantiles_of_whole_tables(spark, most):
    rng = np.random.default_rng(5)
    ties = np.where(rng.random(3000) < 0.6, 7.0, rng.integers(0, 30, 3000).astype(float))
    data = {"a": rng.normal(size=3000), "b": ties, "c": np.full(3000, 2.0)}
    rows = [(float(a), float(b), float(c), None, float(a) if i < 3 else None) for i, (a, b, c) in enumerate(zip(*data.values()))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    ps = [0.0, 0.1, 1 / 3, 0.5, 0.777, 1.0]
    got = order.table_quantiles(df, {x: ps for x in df.columns}, most)
    for name, values in data.items():
        assert np.allclose(got[name], np.quantile(values, ps), rtol=0, atol=1e-12)
    assert got["d"] == [None] * len(ps) and np.allclose(got["e"], np.quantile(data["a"][:3], ps))
    assert order.table_quantiles(df.limit(0), {"a": [0.5]}, most) == {"a": [None]}


def test_running_totals_over_slices(spark):
    rng = np.random.default_rng(6)
    rows = [(None if i % 11 == 0 else "g" if i % 3 else "h", int(rng.integers(0, 20)), i, None if i % 7 == 0 else float(i % 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v int, id int, x double").repartition(7)
    got = order.running(df, ["g"], [F.desc("v"), F.col("id")], {"x": "total"}).collect()
    assert len(got) == 600 and got[0].__fields__ == ["g", "v", "id", "x", "_place", "total"]
    for g in (None, "g", "h"):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["_place"])
        assert [(r["id"], r["_place"]) for r in mine] == [(r[2], i) for i, r in enumerate(want, 1)]
        assert np.allclose([r["total"] for r in mine], np.cumsum([r[3] or 0 for r in want]))
    assert order.running(df.limit(0), [], [F.col("id")]).count() == 0


@pytest.mark.parametrize("n", [0, 3, 23])
def test_folds_without_group(spark, n):
    df = spark.range(n).repartition(5)
    got = sorted((r["id"], r["fold"]) for r in ranking.k_folds(df, None, "id", 5).collect())
    assert got == [(i, f) for f, part in enumerate(np.array_split(np.arange(n), 5)) for i in part]


def test_greedy_matching_against_plain_search(spark):
    rng = np.random.default_rng(9)
    rows = [("s" if i % 3 else "u", i, int(rng.random() < 0.4), float(rng.integers(1, 40)) / 41) for i in rng.permutation(240).tolist()]
    df = spark.createDataFrame(rows, "scene string, id int, t int, p double")
    got = sorted((r["treated_id"], r["control_id"]) for r in causal.match_pairs(df, "scene", "id", "t").collect())
    z = {i: np.log(p / (1 - p)) for _, i, _, p in rows}
    limit, want = 0.2 * np.std(list(z.values()), ddof=1), []
    for scene in "su":
        free = {i for s, i, t, _ in rows if s == scene and not t}
        for i in sorted(i for s, i, t, _ in rows if s == scene and t):
            best = min(free, key=lambda k: (round(abs(z[k] - z[i]), 9), k), default=None)
            if best is not None and abs(z[best] - z[i]) <= limit:
                want.append((i, best))
                free.remove(best)
    assert len(want) > 50 and got == sorted(want)


def test_random_curve_and_tiers(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 50 != 0, F.col("id").cast("double")).alias("v"))
    got = {r["ratio"]: r for r in ranking.random_curve(df, "v", "id", [0.0, 0.4, 1.0], 10).collect()}
    assert got[0.0]["n_repeats"] == 0 and got[0.0]["mean"] is None
    whole = np.mean([i for i in range(500) if i % 50])
    assert abs(got[1.0]["mean"] - whole) < 1e-9 and got[1.0]["std"] < 1e-9 and abs(got[0.4]["mean"] - whole) < 15 and got[0.4]["std"] > 0
    assert {r["tier"]: r["count"] for r in scoring.value_tiers(spark.range(9), "id").groupBy("tier").count().collect()} == {"high": 3, "mid": 3, "low": 3}


def test_importance_configs_and_confounders(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) * [5, 1]
    y = x[:, 0] - 3 * x[:, 1]
    rows = [(float(a), float(b), 1.0, None, "s", float(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1.0, None, "s", 9e9)]
    df = spark.createDataFrame(rows, "a double, b double, k double, none double, name string, y double")
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    got = {r["feature"]: r for r in models.importance(df, ["a", "b"], "y").collect()}
    assert np.allclose([got["a"]["coefficient"], got["b"]["coefficient"]], beta) and got["a"]["rank"] == 1
    assert models.importance(df.limit(0), ["a"], "y").count() == 0
    assert models.feature_configs(df, ["y", "absent"], ["k", "b", "none"], ["a", "b"]) == {"A": ["y"], "B": ["y", "b"], "C": ["y", "b", "a"]}
    assert causal.confounders(df, ["a", "name", "none", "absent", "k"]) == ["a", "k"]


def test_small_tables(spark, tmp_path):
    depth = spark.createDataFrame([([0.0, 2.0, 4.0, None],), ([0.0],), ([],), (None,)], "d array<double>").select(C.depth_stats("d").alias("s")).collect()
    assert tuple(depth[0]["s"]) == (3.0, 1.0, 0.5) and tuple(depth[1]["s"]) == (None, None, 1.0) and depth[2]["s"] is None and depth[3]["s"] is None
    left, right = spark.createDataFrame([("s", 1, 2.0)], "scene string, id int, v double"), spark.createDataFrame([(1, 5.0, 1)], "id int, v double, label int")
    assert [tuple(r) for r in curation.joined_on_shared(left, right, [["scene", "id"], ["id"]]).select("id", "v", "label").collect()] == [(1, 2.0, 1)]
    with pytest.raises(ValueError):
        curation.joined_on_shared(left, right, [["x"]])
    store = StageStore(spark, str(tmp_path))
    store.write("a", left)
    assert [tuple(r) for r in store.inputs_report(["a", "b"]).collect()] == [("a", True, 3), ("b", False, None)]


def test_ranks_of_values_that_are_computed_anew(spark):
    """A column that comes out differently at each reading, as means of doubles do in their last bit, is ranked as read once."""
    drawn = F.udf(lambda i: i + __import__("random").random() / 10, "double").asNondeterministic()
    df = spark.range(60).select((F.col("id") % 2).alias("g"), drawn("id").alias("x"), F.col("id").cast("double").alias("y"))
    found = scoring.correlations(df, ["x"], "y").first()
    assert found["n"] == 60 and found["spearman"] == pytest.approx(1.0)
    assert [r["spearman"] for r in scoring.prediction_metrics(df, ["g"], "y", "x").collect()] == pytest.approx([1.0, 1.0])


def test_joint_indicators_move_rows_by_trajectory_only(spark):
    rows = [(g, i, d, float((i * 7 + g) % 5)) for g in range(3) for i in range(8) for d in ("a", "b")]
    df = spark.createDataFrame(rows, "g int, i int, dim string, v double").repartition(2)
    plan = quality.joint_indicators(df, ["g"], "i", "dim", "v")._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
    assert keys and all(re.fullmatch(r"g#\d+", k) for k in keys)
