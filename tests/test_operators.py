"""Operators on small frames against NumPy, with the edge cases that driver data don't hold."""

import io
import json
import tarfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinetrail.functions import columns as C
from kinetrail.operators import causal, curation, labels, models, quality, ranking, reports, scoring
from kinetrail.operators import timeseries as T
from kinetrail.sources import recordings
from kinetrail.sources.store import StageStore

BY = ["id"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def series(spark, values, name="a"):
    return frame(spark, [(name, i, None if v is None else float(v)) for i, v in enumerate(values)], "id string, k long, v double")


# --- columns ---


def test_column_helpers(spark):
    df = frame(spark, [("a" * 32, " ", 3.0, 0.0, "x/y/../z/run_q60"), ("no", None, None, 2.0, "..\\b//c.h5")], "u string, s string, n double, d double, p string")
    rows = df.select(
        C.is_uuid("u").alias("uuid"), C.non_blank("s").alias("nb"), C.safe_ratio("n", "d").alias("r"), C.mean_of("n", "d").alias("m"), C.safe_path("p").alias("p"),
        C.quantile_suffix("p").alias("q"), C.file_stem("p").alias("stem"), C.sheet_name("p").alias("sheet"), C.to_number(F.lit("x1")).alias("num"),
    ).collect()
    assert [(r["uuid"], r["nb"], r["r"], r["m"]) for r in rows] == [(True, False, None, 1.5), (False, False, None, 2.0)]
    assert rows[0]["q"] == 60 and rows[1]["q"] is None and rows[0]["p"] == "x/y/z/run_q60" and rows[1]["p"] == "b/c.h5" and rows[0]["num"] is None
    assert rows[1]["sheet"] == ".._b__c.h5"


def test_nan_is_null_and_missing_columns_raise(spark):
    df = C.nan_to_null(frame(spark, [(1, float("nan")), (2, 1.0)], "i int, x double"))
    assert df.where("x is null").count() == 1
    with pytest.raises(ValueError, match="missing columns: y"):
        C.require_columns(df, ["x", "y"])


@pytest.mark.parametrize("n", [0, 1, 5, 12, 13, 1000])
def test_sample_places(spark, n):
    got = spark.range(1).select(C.sample_places(F.lit(n), 12).alias("x")).first()["x"]
    assert got == (list(range(n)) if n <= 12 else np.linspace(0, n - 1, 12).astype(int).tolist())


def test_safe_corr_constant(spark):
    df = frame(spark, [(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "x double, y double")
    assert df.agg(C.safe_corr("x", "y").alias("r")).first()["r"] is None


# --- sequences ---


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9])
def test_motion_stats_lengths(spark, n):
    v = np.array([3.0, 1.0, 4.0, 1.5, 9.0, 2.6, 5.0, 3.0, 5.0])[:n]
    rows = T.motion_stats(series(spark, v), BY, ["k"], "v", 0.5).collect()
    if not n:
        assert rows == []
        return
    r = rows[0]
    assert np.isclose(r["mean"], v.mean()) and np.isclose(r["std"], v.std()) and np.isclose(r["path_l1"], np.abs(np.diff(v)).sum())
    assert r["vel_abs_mean"] is None if n < 2 else np.isclose(r["vel_abs_mean"], (np.abs(np.diff(v)) / 0.5).mean())
    assert r["jerk_energy"] is None if n < 4 else np.isclose(r["jerk_energy"], ((np.diff(v, n=3) / 0.5**3) ** 2).sum() * 0.5)


def test_resample_hits_samples_and_leaves_outside_null(spark):
    src = frame(spark, [("a", 0.1, 1.0), ("a", 0.5, 3.0), ("a", 0.5, 7.0), ("a", 0.9, 5.0), ("b", 0.3, 4.0)], "id string, t double, v double")
    grid = frame(spark, [(i, k, k / 10) for i in "ab" for k in range(12)], "id string, k long, t double")
    got = {(r["id"], r["k"]): r["v"] for r in T.linear_resample(src, grid, BY, "t", "v").collect()}
    want = np.interp(np.arange(12) / 10, [0.1, 0.5, 0.9], [1, 3, 5], left=np.nan, right=np.nan)
    for k in range(12):
        assert got["b", k] == 4.0
        assert got["a", k] is None if np.isnan(want[k]) else np.isclose(got["a", k], want[k])


def test_overlap_without_common_time(spark):
    df = frame(spark, [("a", "x", 0.0), ("a", "x", 1.0), ("a", "y", 2.0), ("a", "y", 3.0), ("b", "x", 0.0), ("c", "x", 0.0), ("c", "y", 0.0)], "id string, s string, t double")
    assert [r["id"] for r in T.overlap(df, BY, "t", "s", ["x", "y"]).collect()] == ["c"]


def test_first_of_each_time(spark):
    df = frame(spark, [("a", 5, 2), ("a", 5, 1), ("a", 3, 3)], "id string, t long, seq int")
    assert sorted((r["t"], r["seq"]) for r in T.first_of_each_time(df, BY, "t", "seq").collect()) == [(3, 3), (5, 1)]


@pytest.mark.parametrize("v", [[None, 1, None, None, 4, None], [None, None], [2], [1, 2, 3]])
def test_gap_fill(spark, v):
    got = [r["v"] for r in T.gap_fill(series(spark, v), BY, "k", "v").orderBy("k").collect()]
    x = np.array([np.nan if a is None else a for a in v], float)
    ok = np.isfinite(x)
    want = np.interp(np.arange(len(x)), np.flatnonzero(ok), x[ok]) if ok.any() else np.zeros(len(x))
    assert np.allclose(got, want)


def test_nearest_match_ties_and_bounds(spark):
    bounds = frame(spark, [("a", 10.0, 11.0)], "id string, start_t double, end_t double")
    frames = frame(spark, [("a", i, t) for i, t in enumerate([9.99, 10.0, 10.125, 10.13, 10.99, 11.0, 11.01])], "id string, f int, t double")
    got = {r["f"]: r["k"] for r in T.nearest_match(frames, bounds, BY, "f", "t", 0.25).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 4, 5: 4}  # 10.125 lies midway: the earlier point


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from([True, False, None]), min_size=1, max_size=30))
def test_longest_run(spark, flags):
    best = now = 0
    for f in flags:
        now = now + 1 if f else 0
        best = max(best, now)
    df = frame(spark, [("a", i, f) for i, f in enumerate(flags)], "id string, k int, f boolean")
    assert T.longest_run(df, BY, ["k"], "f").first()["longest"] == best


def test_event_signals_edges(spark):
    flat, gone = series(spark, [2.0] * 6), series(spark, [None] * 4)
    r = T.event_signals(flat, BY, ["k"], "v").first()
    assert (r["peak_offset_l1"], r["stable_len"], r["active_ratio"], r["range_l1"]) == (0.0, 0, 0.0, 0.0)
    r = T.event_signals(gone, BY, ["k"], "v").first()
    assert (r["peak_offset_l1"], r["stable_len"], r["range_l1"]) == (0.0, 0, 0.0)


@pytest.mark.parametrize("v", [list(range(12)), [1, 2, None, 4, 5, 6, 7, 8, 9, 10, 11, 12]])
def test_sliding_windows(spark, v):
    got = [(r["i"], list(r["x"]), r["y"][0]) for r in T.sliding_windows(series(spark, v), BY, ["k"], ["v"], ["v"], 5, 2).orderBy("i").collect()]
    wins = [v[t - 4 : t + 1] for t in range(4, len(v), 2)]
    wins = [w for w in wins if None not in w]
    assert got == [(i, [float(x) for x in w], float(w[-1])) for i, w in enumerate(wins)]


def test_robust_z_fallbacks(spark):
    df = frame(spark, [("a", x) for x in (1.0, 1.0, 1.0, 1.0, 9.0)] + [("b", 2.0)] * 2 + [("c", x) for x in (1.0, 2.0, 4.0, None)], "id string, v double")
    got = {}
    for r in T.robust_z(df, BY, {"v": "z"}).collect():
        got.setdefault(r["id"], []).append(r["z"])
    assert max(got["a"]) == pytest.approx(2.0) and got["b"] == [0.0, 0.0] and sorted(x for x in got["c"] if x is not None)[-1] == pytest.approx(0.6745 * 2) and None in got["c"]


def test_states(spark):
    df = T.tercile_states(series(spark, [1, 5, 9, 2, 6, 10]), BY, "v")
    r = T.state_features(df, BY, "k").first()
    assert (r["final_state"], r["dominant_state"], r["transition_rate"]) == (2, 0, pytest.approx(5 / 6))
    assert r["entropy"] == pytest.approx(np.log(3))


def test_fused_indicators_equal_single_operators(spark):
    rng = np.random.default_rng(1)
    rows = [(f"t{j}", int(t), f"k{rng.integers(3)}", float(x)) for j in range(5) for t, x in zip(np.cumsum(rng.integers(1, 9, 3 + 8 * j)), rng.normal(size=3 + 8 * j))]
    df = frame(spark, rows, "id string, us long, kind string, v double")
    got = {r["id"]: r for r in quality.event_indicators(df, BY, ["us"], "kind", "v").collect()}
    for f, name, col in ((T.anomaly_quality, "C8_anomaly", "anomaly_quality"), (T.noise_quality, "C10_noise", "noise_quality")):
        for r in f(df, BY, ["us"], "v").collect():
            assert got[r["id"]][name] == (pytest.approx(r[col]) if r[col] is not None else None)
    for r in T.timestamp_consistency(df, BY, "us", "us").collect():
        assert got[r["id"]]["C11_timestamps"] == pytest.approx(r["consistency"])
    assert {r["C18_coordination"] for r in got.values()} == {None}
    both = df.withColumn("o", F.col("v") * -2 + F.when(F.col("us") % 2 == 0, 0.5).otherwise(0.0))
    want = {r["id"]: r["coordination"] for r in scoring.channel_coordination(both, BY, ["v", "o"]).collect()}
    for r in quality.event_indicators(both, BY, ["us"], "kind", "v", "o").collect():
        assert r["C18_coordination"] == pytest.approx(want[r["id"]])


# --- scores ---


def test_minmax_cases(spark):
    df = frame(spark, [(1, 2.0, 7.0, None, 4.0), (2, 4.0, 7.0, None, None), (3, 3.0, 7.0, None, 8.0)], "i int, a double, c double, n double, m double")
    rows = scoring.minmax(df, {"a": -1, "c": 1, "n": 1, "m": 1}).orderBy("i").collect()
    assert [r["a"] for r in rows] == [1.0, 0.0, 0.5] and {r["c"] for r in rows} == {1.0} and {r["n"] for r in rows} == {0.5} and [r["m"] for r in rows] == [0.0, 0.5, 1.0]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1)), min_size=2, max_size=12))
def test_entropy_weights_sum_to_one(spark, rows):
    x = np.array(rows)
    got = {r["indicator"]: r["weight"] for r in scoring.entropy_weights(frame(spark, rows, "a double, b double"), ["a", "b"]).collect()}
    s = x.sum(0)
    p = np.where(s > 1e-12, x / np.maximum(s, 1e-300), 1 / len(x))
    d = 1 + (p * np.log(p + 1e-12)).sum(0) / np.log(max(len(x), 2))
    want = np.full(2, 0.5) if d.sum() <= 1e-12 else d / d.sum()
    assert np.allclose([got["a"], got["b"]], want, atol=1e-9) and abs(sum(got.values()) - 1) < 1e-9


def test_ranks_with_ties_and_correlations(spark):
    df = frame(spark, [(1.0, 1.0), (2.0, 1.0), (2.0, 3.0), (5.0, 9.0), (None, 2.0)], "x double, y double")
    r = scoring.correlations(df, ["x"], "y").first()
    rx, ry = np.array([1, 2.5, 2.5, 4]), np.array([1.5, 1.5, 3, 4])
    assert r["n"] == 4 and r["spearman"] == pytest.approx(np.corrcoef(rx, ry)[0, 1])


def test_mutual_information(spark):
    a, b = [0, 0, 1, 1, 2, 2], [0, 0, 1, 1, 1, 0]
    got = scoring.mutual_information(frame(spark, [("g", x, y) for x, y in zip(a, b)], "g string, a int, b int"), ["g"], "a", "b").first()["nmi"]
    h = lambda xs: -sum(p * np.log(p) for p in (np.unique(xs, return_counts=True)[1] / len(xs)))
    joint = h([f"{x}{y}" for x, y in zip(a, b)])
    assert got == pytest.approx((h(a) + h(b) - joint) / ((h(a) + h(b)) / 2))


def test_low_variance(spark):
    df = frame(spark, [(float(i), 1.0, None) for i in range(4)], "a double, c double, n double")
    assert {r["feature"]: r["verdict"] for r in scoring.low_variance(df, ["a", "c", "n"]).collect()} == {"a": "keep", "c": "constant", "n": "all_missing"}


# --- selections ---


def test_selection_sizes_round_half_even(spark):
    df = frame(spark, [(i, "a" if i < 5 else "b", float(i % 3)) for i in range(6)], "global_id int, scene_id string, s double")
    got = ranking.top_share_per_group(df, "scene_id", "s", "global_id", 0.5).groupBy("scene_id").count().collect()
    assert {r["scene_id"]: r["count"] for r in got} == {"a": 2, "b": 1}  # 2.5 rounds to 2
    assert [r["global_id"] for r in ranking.top_n(df, "s", "global_id", 3).orderBy("selected_rank").collect()] == [2, 5, 1]


def test_splits_are_partitions(spark):
    df = frame(spark, [(i, f"s{i % 4}" if i else "lone") for i in range(41)], "id int, scene string")
    for seed in (None, 3):
        rows = ranking.split_train(df, "scene", "id", 0.8, seed).collect()
        assert len(rows) == 41 and {r["split"] for r in rows if r["scene"] == "lone"} == {"train"}
        folds = ranking.k_folds(df, "scene", "id", 5, seed).groupBy("scene", "fold").count().collect()
        assert all(r["count"] <= 2 for r in folds)
    assert ranking.random_n(df, "id", 10, 1).collect() == ranking.random_n(df.repartition(3), "id", 10, 1).collect()


def test_manual_labels_never_fan_out(spark):
    auto = frame(spark, [("a", 0), ("b", 1), ("c", 0)], "trajectory_id string, auto_label int")
    manual = frame(spark, [("a", 1), ("a", 0), ("b", 7), ("x", 1)], "trajectory_id string, manual_label int")
    got = labels.merge_manual(auto, manual, "trajectory_id", "manual_label").collect()
    assert {r["trajectory_id"]: r["final_label"] for r in got} == {"a": 1, "b": 1, "c": 0} and len(got) == 3


def test_rules_fail_on_missing(spark):
    cols = list(labels.RULES)
    df = frame(spark, [("a", *[9.0] * 5), ("b", 9.0, None, 9.0, 9.0, 9.0), ("c", *[0.0] * 5)], "id string, " + ", ".join(f"{c} double" for c in cols))
    got = {r["id"]: (r["auto_label"], r["label_reason"]) for r in labels.auto_label(df, labels.thresholds(df)).collect()}
    assert got["a"] == (1, "auto_success") and got["b"] == (0, "arm_motion_too_small") and got["c"][1].startswith("duration_too_short|")


# --- models ---


def test_ridge_folds_equal_direct_fits(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(12, 2)), rng.normal(size=12)
    df = frame(spark, [(i, *map(float, x[i]), float(y[i])) for i in range(12)], "i int, a double, b double, y double")
    got = {r["i"]: r["pred"] for r in models.ridge_folds(df, ["a", "b"], "y", "i").collect()}
    for i in range(12):
        m = np.arange(12) != i
        mu, sd = x[m].mean(0), x[m].std(0)
        z = (x[m] - mu) / sd
        beta = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y[m] - y[m].mean()))
        assert got[i] == pytest.approx(y[m].mean() + (x[i] - mu) / sd @ beta)


def test_propensity_gradient_is_zero(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), int(rng.random() < 1 / (1 + np.exp(-a)))) for i, a in enumerate(rng.normal(size=200))]
    got = models.propensity(frame(spark, rows, "i int, a double, t int"), ["a"], "t").toPandas()
    z = (got["a"] - got["a"].mean()) / got["a"].std(ddof=0)
    w = np.where(got["t"] == 1, 100 / got["t"].sum(), 100 / (200 - got["t"].sum()))
    beta = np.polyfit(z, np.log(got["p"] / (1 - got["p"])), 1)[0]
    assert (w * (got["p"] - got["t"])).sum() == pytest.approx(0, abs=1e-5) and (w * (got["p"] - got["t"]) * z).sum() + beta == pytest.approx(0, abs=1e-4)


def test_pca_matches_svd(spark):
    x = np.random.default_rng(3).normal(size=(50, 4)) @ np.diag([5, 3, 1, 0.1])
    mean, load, evr = models.pca(frame(spark, [tuple(map(float, r)) for r in x], "a double, b double, c double, d double"), list("abcd"))
    _, s, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(load), np.abs(v), atol=1e-6) and np.allclose(evr, s**2 / (s**2).sum()) and (load.sum(1) >= -1e-12).all()


def test_k_means_and_rarity(spark):
    rows = [(i, float(100 * (i % 2)) + i / 100) for i in range(20)]
    got = quality.mode_rarity(frame(spark, rows, "id int, x double"), ["x"], "id", 1).collect()
    assert len(got) == 20 and all(0 <= r["rarity"] < 1 for r in got)


def test_mlp_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = np.stack([x[:, 0] - x[:, 1], x[:, 2]], 1)
    f = models.train_mlp(x, y, 0, hidden=32, epochs=60, batch=64)
    assert ((f(x) - y) ** 2).mean() < 0.05


def test_greedy_matching(spark):
    rows = [("s", 1, 1, 0.50), ("s", 2, 1, 0.52), ("s", 3, 0, 0.51), ("s", 4, 0, 0.55), ("s", 5, 0, 0.99), ("u", 6, 1, 0.5), ("v", 7, 0, 0.5)]
    df = frame(spark, rows, "scene string, id int, t int, p double")
    got = {r["treated_id"]: r["control_id"] for r in causal.match_pairs(df, "scene", "id", "t", caliper_ratio=0.5).collect()}
    assert got == {1: 3, 2: 4}
    assert causal.match_pairs(df, "scene", "id", "t", caliper_ratio=0.0).count() == 0


def test_bootstrap_is_the_numpy_generator(spark):
    d = np.random.default_rng(1).normal(size=30)
    r = causal.effects(frame(spark, [("y", i, float(x)) for i, x in enumerate(d)], "outcome string, treated_id int, diff double"), ["outcome"]).first()
    rng = np.random.RandomState(42)
    want = np.percentile([d[rng.randint(0, 30, 30)].mean() for _ in range(500)], [2.5, 97.5])
    assert np.allclose([r["ci_low"], r["ci_high"]], want) and r["n_pairs"] == 30


def test_uniqueness_blocks_agree(spark):
    x = np.random.default_rng(2).normal(size=(40, 3))
    df = frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, e array<double>")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2)) + np.diag([np.inf] * 40)
    for block in (7, 2000):
        got = {r["vec_id"]: r["uniqueness"] for r in quality.uniqueness(df, "vec_id", "e", block).collect()}
        assert np.allclose([got[i] for i in range(40)], d.min(1) / d.min(1).max())
    assert quality.uniqueness(df.limit(1), "vec_id", "e").first()["uniqueness"] == 0.0 and quality.uniqueness(df.limit(0), "vec_id", "e").count() == 0


def test_scene_profile_of_one_row_and_stability(spark):
    df = frame(spark, [("a", 1.0), ("b", 1.0), ("b", 3.0)], "scene_id string, Q double")
    got = {r["scene_id"]: r["Q_std"] for r in curation.group_profile(df, ["scene_id"], ["Q"]).collect()}
    assert got["a"] == 0.0 and got["b"] == pytest.approx(2**0.5)


def test_jobs_resume(spark):
    grid = curation.job_grid(spark, ["full", "random"], [0.1 + 0.2, 1.0], [0], [0, 1])
    done = frame(spark, [("random", 0.3, 0)], "strategy string, ratio double, run_seed int")
    assert grid.count() == 5 and curation.pending(grid, done).count() == 4 and curation.pending(grid, done.drop("ratio")).count() == 5


def test_report_tables(spark):
    df = frame(spark, [(f"b{i}", float(i)) for i in range(10)] + [("x", None)], "n string, v double")
    assert [r["n"] for r in reports.extremes(df, "v", "n", 2).collect()] == ["b9", "b8", "b0", "b1"]
    s = frame(spark, [("full", 0.5, 0.9), ("no_q", 0.5, 0.7), ("no_d", 0.5, 1.0)], "strategy string, ratio double, m double")
    assert {r["strategy"]: round(r["loss"], 6) for r in reports.ablation_loss(s, "m", 0.5, "full", ["no_q", "no_d"]).collect()} == {"no_q": 0.2, "no_d": 0.0}


# --- sources and store ---


def test_archives_and_manifest(spark, tmp_path):
    name = "0123456789abcdef0123456789ABCDEF"
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        for member in (f"../x/./{name}.h5", "readme.txt"):
            info = tarfile.TarInfo(member)
            info.size = 3
            t.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "bad.tar").write_bytes(b"not an archive")
    (tmp_path / f"{name}.H5").write_bytes(b"zzz")
    got = {r["archive"].rsplit("/", 1)[1]: r for r in recordings.archive_members(spark, str(tmp_path)).collect()}
    assert got["a.tar.gz"]["member"] == f"x/{name}.h5" and bytes(got["a.tar.gz"]["content"]) == b"abc" and got["bad.tar"]["error"]
    files = recordings.find_files(spark, str(tmp_path))
    assert files.count() == 3
    row = recordings.manifest(files, "S1", "pick").where("is_uuid_file_name").first()
    assert row["trajectory_id"] == name and row["object_id"] is None
    bad = spark.read.format("binaryFile").load(str(tmp_path / "bad.tar"))
    assert recordings.read_hdf5(bad).first()["error"]


def test_metadata_keeps_bad_text(spark):
    good = json.dumps({"resource_info": {"id": "r"}, "equipment_info": {"model": "m"}, "duration_in_ms": 5})
    df = recordings.parse_metadata(frame(spark, [(good,), ("{broken",), (None,)], "metadata string"))
    rows = df.collect()
    assert (rows[0]["resource_id"], rows[0]["equipment_model"], rows[0]["duration_in_ms"], rows[0]["raw_metadata_text"]) == ("r", "m", 5, None)
    assert rows[1]["raw_metadata_text"] == "{broken" and rows[2]["resource_id"] is None


def test_store(spark, tmp_path):
    store = StageStore(spark, str(tmp_path))
    assert store.read("none", optional=True) is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.read("none")
    df = frame(spark, [("S1", 1), ("S2", 2)], "scene_id string, x int")
    store.write("t", df, ["scene_id"])
    store.write("t", frame(spark, [("S2", 5)], "scene_id string, x int"), ["scene_id"])  # only its own partition changes
    assert sorted((r["scene_id"], r["x"]) for r in store.read("t", ["x"]).collect()) == [("S1", 1), ("S2", 5)]
    with pytest.raises(ValueError):
        store.read("t", ["y"])
    assert store.first_of(["none", "t"]).count() == 2
