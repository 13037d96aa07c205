"""The stages against plain NumPy on made trajectories: depth frames, two cameras, missing cells and labels, no effector."""

import math

import numpy as np
import pytest

from kinetrail.operators import signals
from kinetrail.plans import stages
from kinetrail.sources.store import StageStore

IDS = [(s, f"{s}t{j}") for s in ("S1", "S2") for j in range(5)]
PARTS = [(group, kind) for group in ("arm", "effector") for kind in ("action", "state")]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """A store after align, label, features and indicators; S2t4 has no effector, S1t0 lacks cells, one camera has no colour frames."""
    rng = np.random.default_rng(8)
    rows, shots, vision = [], [], []
    for n, (scene, t) in enumerate(IDS):
        for group, kind in PARTS:
            if t == "S2t4" and group == "effector":
                continue
            dims, rate = (3, 2e7) if group == "arm" else (2, 2.5e7)
            for i in range(90):
                v = [float(np.sin(i / (7 + n) + d + n) * (d + 1) + rng.normal() / 30) for d in range(dims)]
                if group == "effector":
                    v = [float(x + (3.0 if 30 < i < 60 else 0.0)) for x in v]
                if t == "S1t0" and group == "effector" and i < 25:
                    v[1] = None
                rows.append((t, scene, kind, group, i, int(i * rate + rng.integers(1000)), v))
        for camera, stream, every in (("head", "color", 3.4e7), ("head", "depth", 3.4e7), ("wrist", "depth", 5e7)):
            for i in range(45):
                at = int(i * every + rng.integers(2_000_000))
                shots.append((t, scene, camera, stream, i, at, float(rng.uniform(0, 255)) if stream == "color" else None))
        if n % 3:
            vision.append((t, scene, 0.1 * n, 0.2))
    store = StageStore(spark, str(tmp_path_factory.mktemp("world")))
    store.write("samples", spark.createDataFrame(rows, "trajectory_id string, scene_id string, kind string, `group` string, seq int, ts_ns long, position array<double>"))
    store.write("frames", spark.createDataFrame(shots, "trajectory_id string, scene_id string, camera string, stream string, frame_idx int, ts_ns long, brightness double"))
    store.write("vision_features", spark.createDataFrame(vision, "trajectory_id string, scene_id string, head_depth_hole_ratio double, wrist_depth_hole_ratio double"))
    store.write("manifest", spark.createDataFrame([(t, s, "pour", f"cup{i % 2}", i != 3) for i, (s, t) in enumerate(IDS)], "trajectory_id string, scene_id string, task_name string, object_id string, is_uuid_file_name boolean"))
    stages.align(store)
    stages.label(store)
    finals = store.read("final_labels").where("trajectory_id <> 'S1t1'")
    store.write("final_labels", spark.createDataFrame(finals.collect(), finals.schema))
    stages.effector(store)
    stages.features(store)
    stages.indicators(store)
    aligned = store.read("aligned").toPandas()
    cells = {}
    for (t, stream), part in aligned.groupby(["trajectory_id", "stream"]):
        cells[t, stream] = part.pivot(index="k", columns="dim", values="v").sort_index().to_numpy(dtype=float)
    table = {n: {r["trajectory_id"]: r.asDict() for r in store.read(n).collect()} for n in ("indicators", "label_signals", "feature_matrix", "align_summary")}
    return store, cells, table, shots


def close(a, b):
    return (a is None and (b is None or b != b)) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9))


# --- plain definitions ---


def edges(seq):
    m = min(len(seq), max(10, int(len(seq) * 0.1)))
    return np.nanmean(seq[:m], axis=0), np.nanmean(seq[-m:], axis=0), np.nanstd(seq[-m:], axis=0)


def events(seq):
    ok = np.isfinite(seq).any(1)
    start = edges(seq)[0]
    start = np.where(np.isfinite(start), start, np.nanmedian(seq, axis=0))
    offset = np.array([np.nanmean(np.abs(r - start)) if o else 0.0 for r, o in zip(seq, ok)])
    steps = np.abs(np.diff(seq, axis=0))
    speed = np.array([0.0 if ok[0] else np.inf, *[np.nanmean(r) if np.isfinite(r).any() else np.inf for r in steps]])
    peak = offset[ok].max()
    moved = ok & (offset >= 0.6 * peak)
    still = np.isfinite(speed) & (speed <= np.percentile(speed[np.isfinite(speed)], 40))
    best = run = 0
    for held in moved & still:
        run = run + 1 if held else 0
        best = max(best, run)
    return peak, moved[ok].mean(), best, np.nanmean(np.nanmax(seq, axis=0) - np.nanmin(seq, axis=0))


def filled(v):
    known = np.flatnonzero(np.isfinite(v))
    return np.interp(np.arange(len(v)), known, v[known]) if len(known) else np.zeros(len(v))


def axis_of(cells):
    frames = np.concatenate([x[np.isfinite(x).all(1)] for (t, s), x in sorted(cells.items()) if s == "effector_state"])
    _, sd, load = np.linalg.svd(frames - frames.mean(0), full_matrices=False)
    return frames.mean(0), load[0] * (-1 if load[0].sum() < 0 else 1), sd[0] ** 2 / (sd**2).sum(), len(frames)


def consistency(ts):
    d = np.diff(np.array(ts, float))
    up = d[d > 0]
    return 0.0 if not len(up) else (np.mean(d > 0) + np.mean((d > 0) & (d <= 3 * np.median(up)))) / 2


# --- tests ---


def test_label_signals(world):
    _, cells, table, _ = world
    for _, t in IDS:
        got, arm = table["label_signals"][t], cells[t, "arm_state"]
        head, tail, spread = edges(arm)
        assert got["aligned_len"] == len(arm) and close(got["arm_change_l1"], np.nanmean(np.abs(tail - head))) and close(got["arm_final_stability"], np.nanmean(spread))
        assert close(got["arm_range_l1"], np.nanmean(np.nanmax(arm, axis=0) - np.nanmin(arm, axis=0)))
        if t == "S2t4":
            assert got["effector_range_l1"] is None and got["stable_grasp_segment_len"] is None
            continue
        seq = cells[t, "effector_state"]
        peak, active, stable, width = events(seq)
        assert close(got["effector_peak_offset_l1"], peak) and close(got["effector_active_ratio"], active) and close(got["effector_range_l1"], width)
        assert got["stable_grasp_segment_len"] == stable and close(got["stable_grasp_segment_s"], stable * 0.01) and close(got["effector_nan_ratio"], np.isnan(seq).mean())


def test_vector_signals_edges(spark):
    schema = "id string, k int, dim int, v double"
    rows = [("flat", k, d, 2.0) for k in range(30) for d in (0, 1)] + [("none", k, 0, None) for k in range(5)] + [("one", 0, 0, 4.0)]
    got = {r["id"]: r for r in signals.vector_signals(spark.createDataFrame(rows, schema), ["id"], "k", "dim", "v").collect()}
    assert (got["flat"]["peak_offset_l1"], got["flat"]["active_ratio"], got["flat"]["stable_len"], got["flat"]["range_l1"]) == (0.0, 0.0, 0, 0.0)
    assert (got["none"]["peak_offset_l1"], got["none"]["stable_len"], got["none"]["nan_ratio"], got["none"]["change_l1"]) == (0.0, 0, 1.0, None)
    assert got["one"]["n_frames"] == 1 and got["one"]["change_l1"] == 0.0


def test_vector_signals_of_many_trajectories(spark, monkeypatch):
    """One shuffle; uneven channels, gaps, heads without values, nameless channels; trajectories across the blocks that a task looks at."""
    monkeypatch.setattr(signals, "BLOCK", 70)
    rng, rows, want = np.random.default_rng(3), [], {}
    for t in range(40):
        n = int(rng.integers(1, 60)) if t else 400
        cells = {c: {int(k): None if rng.random() < 0.2 or (c == "b" and k < n // 2) else round(float(rng.normal()), 2) for k in range(n) if rng.random() < 0.9} for c in ("b", "a", "c")[: 1 + t % 3]}
        cells = {c: x for c, x in cells.items() if x}
        if not cells:
            continue
        rows += [(t, "x", k, c, v) for c, x in cells.items() for k, v in x.items()]
        per, frames = {}, {}
        for c in sorted(cells):
            ks = sorted(cells[c])
            v = np.array([np.nan if cells[c][k] is None else cells[c][k] for k in ks])
            m, some = min(len(v), max(10, int(len(v) * 0.1))), v[~np.isnan(v)]
            head, tail = (x[~np.isnan(x)] for x in (v[:m], v[-m:]))
            per[c] = (head.mean() if len(head) else np.nan, tail.mean() if len(tail) else np.nan, tail.std() if len(tail) else np.nan, np.ptp(some) if len(some) else np.nan)
            centre = head.mean() if len(head) else np.median(some) if len(some) else np.nan
            for i, k in enumerate(ks):
                frames.setdefault(k, []).append((abs(v[i] - centre), abs(v[i] - v[i - 1]) if i else np.nan, i))
        mean = lambda x: np.nan if np.isnan(x).all() else np.nanmean(x)
        found = np.array([(mean([x[0] for x in frames[k]]), mean([x[1] for x in frames[k]]), min(x[2] for x in frames[k])) for k in sorted(frames)])
        off, speed = found[:, 0], np.where((found[:, 2] == 0) & ~np.isnan(found[:, 0]), 0.0, found[:, 1])
        peak, calm = (np.nan if np.isnan(off).all() else np.nanmax(off)), (0.0 if np.isnan(speed).all() else np.nanquantile(speed, 0.4))
        moved = (off >= 0.6 * peak) & (peak > 1e-8)
        runs = "".join("x" if x else " " for x in moved & (speed <= calm + 1e-12)).split()
        h, late, spread, width = np.array(list(per.values())).T
        cells_all = [v for x in cells.values() for v in x.values()]
        want[t] = (
            max(map(len, cells.values())), mean(np.abs(late - h)), mean(spread), sum(v is None for v in cells_all) / len(cells_all), np.nan_to_num(mean(width)), peak if peak > 1e-8 else 0.0,
            np.nan_to_num(mean(np.where(np.isnan(off), np.nan, moved))), max(map(len, runs), default=0),
        )
    rows += [(0, "x", k, None, 5.0) for k in range(400)] + [(None, "x", 0, "a", 1.0), (77, "x", 0, None, 1.0)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "id int, more string, k int, dim string, v double")
    got = signals.vector_signals(df, ["id", "more"], "k", "dim", "v")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    told = {r["id"]: [np.nan if r[c] is None else r[c] for c in signals.EVENT_COLUMNS] for r in got.collect()}
    assert told.keys() == want.keys()
    for t in want:
        # the nameless channel of trajectory 0 counts among its cells, not in its frames
        skip = {0, 1, 2, 3, 4} if t == 0 else set()
        assert all(i in skip or np.isclose(told[t][i], x, equal_nan=True) for i, x in enumerate(want[t])), (t, told[t], want[t])


def test_vector_signals_add_channels_in_their_order(spark):
    """A mean on half a millionth: its last bit doesn't follow the order in which rows come."""
    widths = {0: 0.98, 1: 1.0, 2: 0.7999999999999999, 3: 1.03387}
    rows = [(t, k, (d + t) % 4, k * widths[(d + t) % 4]) for t in range(200) for d in range(4) for k in (1, 0)]
    found = signals.vector_signals(spark.createDataFrame(rows, "id int, k int, dim int, v double").repartition(7), ["id"], "k", "dim", "v")
    assert {r["range_l1"] for r in found.collect()} == {(((0.98 + 1.0) + 0.7999999999999999) + 1.03387) / 4}


def test_effector_axis_and_features(world):
    store, cells, table, _ = world
    mean, load, share, n = axis_of(cells)
    axis = store.read("effector_axis").first()
    assert axis["status"] == "ok" and axis["n_fit_samples"] == n and axis["n_features"] == 2
    assert np.allclose(axis["components"], load) and np.allclose(axis["mean"], mean) and close(axis["explained_variance_ratio"], share)
    for _, t in IDS:
        got = table["feature_matrix"][t]
        assert close(got["global_arm_path_l1"], np.nansum(np.abs(np.diff(cells[t, "arm_state"], axis=0)))) and close(got["global_duration_s"], (len(cells[t, "arm_state"]) - 1) * 0.01)
        assert close(got["arm_action_range_1"], np.ptp(cells[t, "arm_action"][:, 1]))
        if t == "S2t4":
            assert got["semantic_entropy"] is None and got["global_effector_path_l1"] is None
            continue
        seq = cells[t, "effector_state"]
        v = filled(np.where(np.isfinite(seq).all(1), (seq - mean) @ load, np.nan))
        states = (v > np.percentile(v, 33.3)).astype(int) + (v > np.percentile(v, 66.7))
        shares = np.array([(states == s).mean() for s in range(3)])
        assert all(close(got[f"semantic_state_ratio_{s}"], shares[s]) for s in range(3))
        assert close(got["semantic_transition_rate"], (states[1:] != states[:-1]).sum() / len(states)) and got["semantic_final_state"] == states[-1]
        assert got["semantic_dominant_state"] == np.bincount(states).argmax()


def test_axis_without_frames(spark):
    frames = spark.createDataFrame([("a", 0, [1.0, None]), ("a", 1, [3.0, 5.0]), ("b", 0, [None, None])], "id string, k int, vector array<double>")
    one = signals.fit_axis(frames)
    assert one.first()["status"] == "not_enough_effector_frames" and one.first()["n_fit_samples"] == 1
    got = {(r["id"], r["k"]): r["v"] for r in signals.scalar_signal(frames, one, ["id"], "k").collect()}
    assert got == {("a", 0): 1.0, ("a", 1): 4.0, ("b", 0): 0.0}
    assert signals.fit_axis(frames.where("id = 'b'")).first()["status"] == "no_valid_effector_frames"


def test_every_indicator(world):
    store, cells, table, shots = world
    mean, load, _, _ = axis_of(cells)
    matches = store.read("matches").orderBy("frame_idx").collect()
    samples = store.read("samples").orderBy("seq").collect()
    matrix = store.read("feature_matrix").orderBy("trajectory_id").toPandas().set_index("trajectory_id")
    numbers = matrix.drop(columns=["scene_id"]).astype(float)
    numbers = numbers.fillna(numbers.median()).fillna(0.0)
    z = ((numbers - numbers.mean()) / numbers.std(axis=0).where(numbers.std(axis=0) > 1e-12, 1.0)).to_numpy()
    near = (np.linalg.norm(z[:, None] - z[None], axis=2) + np.diag([np.inf] * len(z))).min(1)
    unique = dict(zip(numbers.index, near / near.max()))
    for scene, t in IDS:
        got = table["indicators"][t]
        n = len(cells[t, "arm_state"])
        duration = (n - 1) * 0.01
        mine = [m for m in matches if m["trajectory_id"] == t]
        ratios = [min(1.0, sum(m["camera"] == c and m["stream"] == "color" for m in mine) / max(1.0, duration * 30)) for c in ("head", "wrist")]
        assert close(got["C3_visual_completeness"], np.mean(ratios))
        holes = [matrix.loc[t, c] for c in ("head_depth_hole_ratio", "wrist_depth_hole_ratio")]
        assert close(got["C4_depth_validity"], None if np.isnan(holes).all() else np.clip(1 - np.nanmean(holes), 0, 1))
        gaps = [np.isnan(cells[t, f"{g}_{k}"]).mean() for g, k in PARTS if (t, f"{g}_{k}") in cells]
        assert close(got["C5_joint_completeness"], (1.0 + 1 - np.mean(gaps)) / 2)
        stamps = [[r["ts_ns"] for r in samples if r["trajectory_id"] == t and (r["group"], r["kind"]) == p] for p in PARTS]
        stamps += [[s[5] for s in shots if s[0] == t and (s[2], s[3]) == c] for c in (("head", "color"), ("head", "depth"), ("wrist", "depth"))]
        assert close(got["C11_timestamp_consistency"], np.mean([consistency(x) for x in stamps if x]))
        assert close(got["C12_scene_entropy"], 1.0) and close(got["C13_object_diversity"], 1 / 4)
        if t == "S2t4":
            assert got["C14_atomic_skill_diversity"] is None
        else:
            seq = cells[t, "effector_state"]
            v = filled(np.where(np.isfinite(seq).all(1), (seq - mean) @ load, np.nan))
            states = (v > np.percentile(v, 33.3)).astype(int) + (v > np.percentile(v, 66.7))
            p = np.array([(states == s).mean() for s in range(3)])
            p = p[p > 0]
            assert close(got["C14_atomic_skill_diversity"], -(p * np.log(p + 1e-12)).sum() / math.log(3))
        offsets = [np.mean([abs(m["offset_s"]) for m in mine if (m["camera"], m["stream"]) == c]) for c in (("head", "color"), ("head", "depth"), ("wrist", "depth"))]
        assert close(got["C16_multimodal_alignment"], np.clip(1 - np.mean(offsets) / 0.05, 0, 1))
        colour = [m for m in mine if (m["camera"], m["stream"]) == ("head", "color")]
        bright, motion = [], []
        for i, s in enumerate(s for s in shots if s[0] == t and s[3] == "color"):
            if i < len(colour):
                bright.append(s[6])
                motion.append(np.linalg.norm(cells[t, "arm_action"][colour[i]["k"]]))
        bins = lambda v: np.digitize(v, np.unique(np.percentile(v, [20, 40, 60, 80])))
        a, b = bins(bright), bins(motion)
        pa, pb = (np.bincount(x) / len(x) for x in (a, b))
        mi = sum((((a == i) & (b == j)).mean()) * math.log(((a == i) & (b == j)).mean() / (pa[i] * pb[j])) for i in set(a) for j in set(b) if ((a == i) & (b == j)).any())
        entropy = lambda p: -sum(x * math.log(x) for x in p if x > 0)
        assert close(got["C17_visual_joint_mi"], mi / ((entropy(pa) + entropy(pb)) / 2))
        assert close(got["C19_duplicate_uniqueness"], unique[t])
        assert got["C21_label_completeness"] == float(t != "S1t1") and got["C22_metadata_standardization"] == float(t != "S1t3")
        assert got["C6_attribute_completeness"] == 4 / 8 and got["C23_scene_description_completeness"] == 3 / 9
    rarity = [table["indicators"][t]["C15_motion_mode_diversity"] for _, t in IDS]
    sizes = [round((1 - r) * len(IDS)) for r in rarity]  # each trajectory's cluster size: sizes add up to whole clusters
    assert all(0 <= r < 1 for r in rarity) and all(sizes.count(k) % k == 0 for k in set(sizes)) and sum(sizes.count(k) // k for k in set(sizes)) <= 3


def test_align_summary(world):
    store, cells, table, _ = world
    matches = store.read("matches").collect()
    for _, t in IDS:
        got = table["align_summary"][t]
        mine = [abs(m["offset_s"]) * 1000 for m in matches if (m["trajectory_id"], m["camera"], m["stream"]) == (t, "head", "depth")]
        assert got["head_depth_matched_n"] == len(mine) and close(got["head_depth_mean_offset_ms"], np.mean(mine)) and got["aligned_len"] == len(cells[t, "arm_state"])
        assert got["arm_state_dim"] == 3 and got["effector_state_dim"] == (None if t == "S2t4" else 2)
        assert close(got["effector_state_nan_ratio"], None if t == "S2t4" else np.isnan(cells[t, "effector_state"]).mean())


def test_value_model_selection_evaluation_and_effects(world, spark):
    """From windows to effects: every stage's table is there, grids resume, small cells are told with a reason."""
    store = world[0]
    cfg = stages.Config.preset("fast", epochs=2, ratios=(0.5, 1.0), run_seeds=(0, 1), random_seeds=(0, 1), min_rows=4, folds=3)
    stages.bc_samples(store, cfg, "arm_only")
    arm = store.read("bc_samples")
    assert arm.select("trajectory_id").distinct().count() == 10 and {(len(r["x"]), len(r["y"])) for r in arm.collect()} == {(15, 3)}
    with pytest.raises(ValueError):
        stages.bc_samples(store, cfg, "legs")
    store.write("bc_samples", spark.createDataFrame([], arm.schema))
    stages.bc_samples(store, cfg)  # of both groups: none of the trajectory without an effector
    assert {(len(r["x"]), len(r["y"])) for r in store.read("bc_samples").collect()} == {(25, 5)}
    scores = {"C8_joint_anomaly_quality": 1, "C11_timestamp_consistency": 1, "C16_multimodal_alignment": 1}
    stages.score(store, scores, {"accuracy": ["C8_joint_anomaly_quality"], "consistency": ["C11_timestamp_consistency", "C16_multimodal_alignment"]}, scope="global")
    stages.value(store, cfg)
    stages.meta_value(store)
    value = store.read("trajectory_value").collect()
    assert len(value) == 10 and {r["value_source"] for r in value} == {"empirical"} and store.read("scene_quality").count() == 2
    strategies = ["full", "random", "high_Q_global", "high_Q_stratified", "high_delta"]
    stages.value(store, cfg)
    stages.curate(store, cfg, strategies)
    stages.evaluate(store, cfg)
    metrics = store.read("curation_metrics")
    jobs = store.read("curation_selection").select("strategy", "ratio", "run_seed").distinct().count()
    assert jobs == metrics.count() == 1 + 4 * 2 * 2 and metrics.where("test_nmse is null or n_train_windows = 0").count() == 0
    files = sorted(metrics.inputFiles())
    stages.curate(store, cfg, strategies)
    stages.evaluate(store, cfg)
    assert sorted(store.read("curation_metrics").inputFiles()) == files  # nothing is trained again
    stages.curate(store, cfg, [*strategies, "low_delta"])
    stages.evaluate(store, cfg)
    assert store.read("curation_metrics").count() == jobs + 4 and set(files) <= set(store.read("curation_metrics").inputFiles())
    full = store.read("curation_metrics").where("strategy = 'full'").first()
    one = store.read("curation_selection").where("strategy = 'full'")
    assert full["n_train_trajectories"] == one.count() == store.read("curation_split").where("split = 'pool'").count()
    assert store.read("curation_summary").where("strategy = 'random' and relative_to_random_nmse_mean is not null").count() == 2
    assert store.read("curation_per_scene").select("test_scene").distinct().count() == 2
    stages.fold_labels(store, cfg)
    assert store.read("trajectory_labels", ["trajectory_imitation_score"]).count() == 9
    stages.modeling_table(store)
    assert store.read("modeling_table").count() == 9 and not store.read("modeling_check").first()["has_duplicates"]
    stages.regression(store, cfg)
    summary = {(r["protocol"], r["config"]): r for r in store.read("regression_summary").collect()}
    assert set(summary) == {(p, c) for p in ("random_kfold", "leave_one_scene") for c in "ABC"} and all(r["n_samples"] == 9 for r in summary.values())
    assert summary["leave_one_scene", "A"]["n_folds"] == 2 and store.read("regression_predictions").count() == 9 * 6 and store.read("regression_importance").where("config = 'C'").count() > 5
    stages.causal_effects(store, ["n_bc_windows"], {"trajectory_imitation_score": 1, "trajectory_normalized_mse": -1}, ["Q_score"], (0.5,), cfg, {"second": ["S2"], "nowhere": ["S7"]})
    told = {r["heterogeneity_group"]: r["status"] for r in store.read("causal_cells").collect()}
    assert told["nowhere"] == "too_few_rows" and told["all"] == "ok"
    for r in store.read("causal_effects").collect():
        assert math.isclose(r["att_beneficial_direction"], r["att_raw"] * (1 if r["outcome"].endswith("score") else -1)) and r["ci95_lo_beneficial"] <= r["ci95_hi_beneficial"]
    assert store.read("causal_robustness").where("n_estimates > 0").count() == store.read("causal_effects").select("heterogeneity_group", "outcome").distinct().count()


def test_value_model_predicts_scenes_without_a_value(spark, tmp_path):
    """Ridge on scene means, scored by leaving a scene out; the scene without a measured value gets the model's."""
    rng = np.random.default_rng(3)
    scenes = [f"S{i}" for i in range(7)]
    rows = [(s, f"{s}t{j}", float(i / 10 + rng.normal() / 50), float(rng.uniform()), 1.0) for i, s in enumerate(scenes) for j in range(4 + i % 3)]
    store = StageStore(spark, str(tmp_path))
    store.write("quality_scores", spark.createDataFrame(rows, "scene_id string, trajectory_id string, Q_score double, Q_accuracy double, Q_usability double"))
    delta = {s: 0.3 * i + float(rng.normal()) / 20 for i, s in enumerate(scenes[:6])}
    store.write("delta_summary", spark.createDataFrame(list(delta.items()), "scene_id string, delta_score_mean double"))
    stages.meta_value(store)
    of = lambda s, c: np.mean([r[c] for r in rows if r[0] == s])
    x = np.array([[sum(r[0] == s for r in rows), of(s, 2), of(s, 3)] for s in scenes])
    y = np.array([delta[s] for s in scenes[:6]])

    def ridge(at, to):
        mean, sd = x[at].mean(0), x[at].std(0)
        a = (x - mean) / sd
        return y[at].mean() + a[to] @ np.linalg.solve(a[at].T @ a[at] + np.eye(3), a[at].T @ (y[at] - y[at].mean()))

    loo = {r["scene_id"]: r["delta_score_pred"] for r in store.read("value_loocv").collect()}
    for i, s in enumerate(scenes[:6]):
        assert math.isclose(loo[s], ridge([j for j in range(6) if j != i], i), rel_tol=1e-7)
    value = {r["scene_id"]: r for r in store.read("trajectory_value").collect()}
    assert value["S6"]["value_source"] == "predicted" and math.isclose(value["S6"]["delta"], ridge(list(range(6)), 6), rel_tol=1e-7)
    assert value["S0"]["value_source"] == "empirical" and value["S0"]["delta"] == delta["S0"]
    found = {r["feature"]: r for r in store.read("value_correlations").collect()}
    assert "Q_usability_mean" not in found and math.isclose(found["Q_score_mean"]["pearson"], np.corrcoef(x[:6, 1], y)[0, 1]) and found["Q_score_mean"]["pearson_p"] < 0.05
    assert store.read("value_metrics").first()["n"] == 6
