"""The pipeline's stages over stage tables: align, label, features, indicators, score, windows, value, curate, effects.

Each stage reads its inputs from a :class:`StageStore`, is one lazy plan up to its write, and never loops over
trajectories. Scenes are handled together; ``scene_id`` partitions the stored tables.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.functions.columns import clip, mean_of, numeric_columns, require_columns, safe_ratio, sample_places
from kinetrail.operators import causal, curation, effects, labels, models, neighbours, quality, ranking, scoring, signals, training, validation
from kinetrail.operators import timeseries as T
from kinetrail.sources import records as rec
from kinetrail.sources.recordings import manifest
from kinetrail.sources.store import StageStore, scratch

KEYS = ["scene_id", "trajectory_id"]


@dataclass(frozen=True)
class Config:
    """Run settings. Precedence: defaults, then preset, then what the caller names."""

    step_s: float = 0.01
    window: int = 5
    stride: int = 2
    epochs: int = 35
    ratios: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8, 1.0)
    run_seeds: tuple[int, ...] = (0, 1, 2)
    random_seeds: tuple[int, ...] = (0, 1, 2, 3, 4)
    train_share: float = 0.8
    test_share: float = 0.2
    folds: int = 5
    min_rows: int = 30

    @classmethod
    def preset(cls, name: str = "", **own) -> Config:
        base = {"": {}, "fast": {"epochs": 5, "ratios": (0.2, 0.6, 1.0), "run_seeds": (0,)}, "smoke": {"epochs": 1, "ratios": (1.0,), "run_seeds": (0,), "random_seeds": (0,)}}[name]
        return cls(**{**base, **own})


def ingest(store: StageStore, base: str, scene: str, task: str, object_id: str | None = None, opener=rec.open_hdf5, suffix: str = ".h5") -> None:
    """Recording files and archives below ``base`` -> records/<scene>, samples, frames, manifest, raw_metadata, recording_errors.

    Files are read once; the tables are selections of the stored records. A scene that is read again replaces its own rows.
    """
    files, bad = rec.find_contents(store.spark, base, suffix)
    where = store.path(f"records/{scene}")
    rec.read_records(files, opener).write.mode("overwrite").partitionBy("part").parquet(where)
    read = store.spark.read.schema(rec.RECORDS).parquet(where)
    store.write("samples", rec.samples_of(read, scene), ["scene_id"])
    store.write("frames", rec.frames_of(read, scene), ["scene_id"])
    summary = store.write("raw_metadata", rec.recording_summary(read).withColumn("scene_id", F.lit(scene)), ["scene_id"])
    store.write("manifest", manifest(summary.where(F.col("scene_id") == scene).select("path"), scene, task, object_id), ["scene_id"])
    errors = read.where("part = 'error'").select("path", "name", "text").union(bad.select("path", F.lit(None).cast("string"), "text"))
    store.write("recording_errors", errors.withColumn("scene_id", F.lit(scene)), ["scene_id"])


def align(store: StageStore, cfg: Config = Config()) -> None:
    """samples, frames -> aligned (resampled channels, long), matches, align_summary."""
    samples = store.read("samples", [*KEYS, "kind", "group", "seq", "ts_ns", "position"])
    samples = samples.withColumn("t", F.col("ts_ns") * 1e-9).withColumn("stream", F.concat_ws("_", "group", "kind"))
    samples = T.first_of_each_time(samples, [*KEYS, "stream"], "ts_ns", "seq")
    streams = [r[0] for r in samples.select("stream").distinct().orderBy("stream").collect()]  # a handful of group names
    bounds = T.overlap(samples, KEYS, "t", "stream", [s for s in streams if s.startswith("arm")])
    grid = T.regular_grid(bounds, KEYS, cfg.step_s)
    long = samples.select(*KEYS, "stream", "t", F.posexplode("position").alias("dim", "v"))
    channels = long.select(*KEYS, "stream", "dim").distinct()
    points = grid.join(channels, KEYS).withColumn("t", F.col("start_t") + F.col("t"))
    aligned = T.linear_resample(long, points, [*KEYS, "stream", "dim"], "t", "v")
    store.write("aligned", aligned, ["scene_id"])
    frames = store.read("frames", optional=True)
    if frames is not None:
        shots = frames.withColumn("t", F.col("ts_ns") * 1e-9).select(*KEYS, "camera", "stream", "frame_idx", "t")
        named = shots.withColumn("shot", F.struct("camera", "stream", "frame_idx"))
        matches = T.nearest_match(named, bounds, KEYS, "shot", "t", cfg.step_s).select(*KEYS, "shot.*", "rel_t", "k", "grid_t", "offset_s")
        store.write("matches", matches, ["scene_id"])
    bounds = store.write("bounds", bounds)
    store.write("align_summary", _align_summary(store.read("aligned"), store.read("matches", optional=True), bounds, cfg.step_s))


def _align_summary(aligned, matches, bounds, step_s: float):
    """Per trajectory: grid length and duration, each stream's channels and share of missing cells, each camera stream's matches and mean offset."""
    streams = [r[0] for r in aligned.select("stream").distinct().orderBy("stream").collect()]  # a handful of group names
    shape = aligned.groupBy(*KEYS).pivot("stream", streams).agg((F.max("dim") + 1).alias("dim"), F.avg(F.col("v").isNull().cast("double")).alias("nan_ratio"))
    if matches is None:
        none = bounds.select(*KEYS, F.lit("").alias("camera_stream"), F.lit(None).cast("double").alias("offset_s")).limit(0)
        return T.align_summary(none, bounds, KEYS, "camera_stream", [], step_s).join(shape, KEYS, "left")
    named = matches.withColumn("camera_stream", F.concat_ws("_", "camera", "stream"))
    shots = [r[0] for r in named.select("camera_stream").distinct().orderBy("camera_stream").collect()]
    return T.align_summary(named, bounds, KEYS, "camera_stream", shots, step_s).join(shape, KEYS, "left")


def effector(store: StageStore, channel: str = "effector_state") -> None:
    """aligned -> effector_axis, effector_signal: one axis fitted over all trajectories' frames, and every frame's place on it."""
    rows = store.read("aligned", [*KEYS, "stream", "dim", "k", "v"]).where(F.col("stream") == channel)
    frames = scratch(signals.frame_vectors(rows, KEYS, "k", "dim", "v"), "effector-frames")
    axis = store.write("effector_axis", signals.fit_axis(frames))
    store.write("effector_signal", signals.scalar_signal(frames, axis, KEYS, "k"), ["scene_id"])


def _semantic(store: StageStore):
    """Semantic features of the effector signal, which is made if it isn't there yet."""
    if (signal := store.read("effector_signal", optional=True)) is None:
        effector(store)
        signal = store.read("effector_signal")
    return signals.semantic_features(signal, KEYS, "k")


def label(store: StageStore, channel: str = "effector_state", cfg: Config = Config()) -> None:
    """aligned -> label_signals, auto_labels, review_queue, final_labels (with manual_review if it exists).

    The event signals look at all channels of the effector and the arm; a trajectory without an effector has NULLs there.
    """
    aligned = store.read("aligned", [*KEYS, "stream", "dim", "k", "v"])
    length = aligned.groupBy(*KEYS).agg((F.max("k") + 1).alias("aligned_len"), (F.max("k") * F.lit(cfg.step_s)).alias("duration_s"))
    parts = {}
    for name, stream in (("arm", "arm_state"), ("effector", channel)):
        found = signals.vector_signals(aligned.where(F.col("stream") == stream), KEYS, "k", "dim", "v", cfg.step_s)
        parts[name] = found.select(*KEYS, *[F.col(c).alias(f"{name}_{c}") for c in signals.EVENT_COLUMNS if c != "n_frames"])
    arm = parts["arm"].select(*KEYS, "arm_change_l1", "arm_range_l1", "arm_final_stability")
    grasp = {"effector_stable_len": "stable_grasp_segment_len", "effector_stable_s": "stable_grasp_segment_s"}
    made = length.join(arm, KEYS, "left").join(parts["effector"].withColumnsRenamed(grasp), KEYS, "left")
    made = store.write("label_signals", made)
    auto = store.write("auto_labels", labels.auto_label(made, labels.thresholds(made)))
    store.write("review_queue", labels.review_queue(auto))
    manual = store.read("manual_review", ["trajectory_id", "manual_label"], optional=True)
    if manual is None:
        manual = auto.select("trajectory_id", F.lit(None).cast("int").alias("manual_label")).limit(0)
    store.write("final_labels", labels.merge_manual(auto, manual, "trajectory_id", "manual_label"))


def features(store: StageStore, cfg: Config = Config()) -> None:
    """aligned, and vision_features where it exists -> feature_matrix: one wide row a trajectory.

    Motion statistics of every channel, semantic features of the effector, duration and paths, and the columns of
    ``vision_features`` (colour figures, depth hole ratios).
    """
    aligned = store.read("aligned", [*KEYS, "stream", "dim", "k", "v"])
    stats = T.motion_stats(aligned, [*KEYS, "stream", "dim"], ["k"], "v", cfg.step_s)
    names = ["mean", "std", "range", "vel_abs_mean", "jerk_energy"]
    long = stats.unpivot([*KEYS, "stream", "dim"], names, "stat", "x").withColumn("name", F.concat_ws("_", "stream", "stat", "dim"))
    wanted = [r[0] for r in long.select("name").distinct().orderBy("name").collect()]  # channels x statistics
    wide = long.groupBy(*KEYS).pivot("name", wanted).agg(F.first("x", True))
    wide = wide.join(aligned.groupBy(*KEYS).agg((F.max("k") * F.lit(cfg.step_s)).alias("global_duration_s")), KEYS, "left")
    for name in ("arm", "effector"):
        path = signals.path_l1(aligned.where(F.col("stream") == f"{name}_state"), KEYS, "k", "dim", "v", f"global_{name}_path_l1")
        wide = wide.join(path, KEYS, "left")
    wide = wide.join(_semantic(store), KEYS, "left")
    vision = store.read("vision_features", optional=True)
    if vision is not None:
        wide = wide.join(vision.drop(*[c for c in vision.columns if c in wide.columns and c not in KEYS]), KEYS, "left")
    store.write("feature_matrix", wide)


def indicators(store: StageStore, cfg: Config = Config(), seed: int = 42) -> None:
    """aligned, samples, bounds, and where they exist frames, matches, feature_matrix, manifest, raw_metadata, final_labels -> indicators.

    One row a trajectory; an indicator whose inputs aren't there is NULL, but C21 and C22, where nothing counts as 0.
    Frames may hold a mean ``brightness``, for C17. Tables that lack a trajectory leave NULLs.
    """
    aligned = store.read("aligned", [*KEYS, "stream", "dim", "k", "v"])
    bounds = store.read("bounds", [*KEYS, "start_t", "end_t"])
    last = F.floor((F.col("end_t") - F.col("start_t") + T.EPS) / F.lit(cfg.step_s))
    bounds = bounds.select(*KEYS, (last * F.lit(cfg.step_s)).alias("duration_s"))
    arm = aligned.where(F.col("stream") == "arm_state")
    found = bounds.join(quality.joint_indicators(arm, KEYS, "k", "dim", "v").withColumnsRenamed({"C8": "C8_joint_anomaly_quality", "C10": "C10_joint_noise_quality", "C18": "C18_joint_coordination"}), KEYS, "left")
    holes = aligned.where(F.col("stream").rlike("_(state|action)$")).groupBy(*KEYS, "stream").agg(F.avg(F.col("v").isNull().cast("double")).alias("r"), F.max("k").alias("k"))
    holes = holes.groupBy(*KEYS).agg(F.avg("r").alias("r"), (F.max("k") + 1).alias("n")).join(bounds, KEYS)
    length = safe_ratio("n", F.floor(F.col("duration_s") / F.lit(cfg.step_s) + F.lit(1e-9)) + 1)
    found = found.join(holes.select(*KEYS, mean_of(length, 1 - F.col("r")).alias("C5_joint_completeness")), KEYS, "left")

    stamps = store.read("samples", [*KEYS, "kind", "group", "seq", "ts_ns"]).select(*KEYS, F.concat_ws("_", "group", "kind").alias("stream"), "seq", "ts_ns")
    frames = store.read("frames", optional=True)
    if frames is not None:
        stamps = stamps.union(frames.select(*KEYS, F.concat_ws("_", F.lit("camera"), "camera", "stream"), F.col("frame_idx").alias("seq"), "ts_ns"))
    steady = T.timestamp_consistency(stamps, [*KEYS, "stream"], "ts_ns", "seq").groupBy(*KEYS).agg(F.avg("consistency").alias("C11_timestamp_consistency"))
    found = found.join(steady, KEYS, "left")

    matrix = store.read("feature_matrix", optional=True)
    states = _semantic(store) if matrix is None or "semantic_state_ratio_0" not in matrix.columns else matrix
    found = found.join(signals.skill_diversity(states).select(*KEYS, F.col("C14").alias("C14_atomic_skill_diversity")), KEYS, "left")
    if matrix is not None:
        found = found.join(_model_indicators(matrix, seed), KEYS, "left")

    matches = store.read("matches", optional=True)
    if matches is not None:
        shots = matches.groupBy(*KEYS, "camera").agg(F.count_if(F.col("stream") == "color").alias("n")).join(bounds, KEYS)
        shots = shots.groupBy(*KEYS).agg(F.avg(safe_ratio("n", F.greatest(F.lit(1.0), F.col("duration_s") * 30.0))).alias("C3_visual_completeness"))
        offsets = matches.groupBy(*KEYS, "camera", "stream").agg((F.avg(F.abs("offset_s")) * 1000).alias("ms")).groupBy(*KEYS).agg(F.avg("ms").alias("ms"))
        offsets = quality.alignment_quality(offsets, ["ms"]).select(*KEYS, F.col("C16").alias("C16_multimodal_alignment"))
        found = found.join(shots, KEYS, "left").join(offsets, KEYS, "left")
        if frames is not None and "brightness" in frames.columns:
            found = found.join(_visual_joint(frames, matches, aligned), KEYS, "left")
    manifest, metadata, finals = (store.read(n, optional=True) for n in ("manifest", "raw_metadata", "final_labels"))
    standard = F.lit(0.0)
    if manifest is not None:
        about = manifest
        if metadata is not None:
            about = about.join(metadata.drop(*[c for c in metadata.columns if c in manifest.columns and c not in KEYS]), KEYS, "left")
        about = quality.attribute_completeness(quality.attribute_completeness(about), quality.DESCRIPTION_FIELDS, "C23")
        known = F.col("is_uuid_file_name").cast("double") if "is_uuid_file_name" in about.columns else F.lit(0.0)
        about = about.select(*KEYS, F.col("C6").alias("C6_attribute_completeness"), known.alias("_known"), F.col("C23").alias("C23_scene_description_completeness"))
        found = found.join(about.dropDuplicates(KEYS), KEYS, "left")
        standard = F.coalesce("_known", F.lit(0.0))
        found = scoring.beside(found, scoring.category_entropy(manifest, "scene_id").withColumnRenamed("entropy", "C12_scene_entropy"))
        if "object_id" in manifest.columns:
            objects = manifest.groupBy("scene_id").agg(((F.count_distinct("object_id") - 1) / F.greatest(F.count("*") - 1, F.lit(1))).alias("C13_object_diversity"))
            found = found.join(objects, "scene_id", "left")
    given = F.lit(0.0)
    if finals is not None:
        found = found.join(finals.groupBy(*KEYS).agg(F.max(F.col("final_label").isNotNull().cast("double")).alias("_given")), KEYS, "left")
        given = F.coalesce("_given", F.lit(0.0))
    found = found.withColumns({"C21_label_completeness": given, "C22_metadata_standardization": standard})
    store.write("indicators", found.drop("_given", "_known"))


def _model_indicators(matrix, seed: int):
    """C4, C15 and C19 from the feature matrix: depth holes, rarity of the motion cluster, distance to the nearest other row."""
    rows = scratch(matrix.withColumn("_id", F.to_json(F.struct(*KEYS))), "feature-rows")
    numbers = [c for c in numeric_columns(rows) if c not in KEYS]
    holes = [c for c in numbers if c.endswith("_depth_hole_ratio")]
    motion = [c for c in numbers if c.startswith(("arm_state_range_", "arm_state_vel_abs_mean_", "arm_action_range_", "arm_action_vel_abs_mean_"))]
    found = rows.select(*KEYS, "_id", (clip(1 - mean_of(*holes)) if holes else F.lit(None).cast("double")).alias("C4_depth_validity"))
    if rows.limit(2).count() < 2:  # nothing to compare with
        return found.drop("_id").withColumns({"C15_motion_mode_diversity": F.lit(None).cast("double"), "C19_duplicate_uniqueness": F.lit(None).cast("double")})
    if motion:
        modes = quality.mode_rarity(rows.select("_id", *motion), motion, "_id", seed)
        found = found.join(modes.select("_id", F.col("rarity").alias("C15_motion_mode_diversity")), "_id", "left")
    if numbers:
        filled = models.impute_median(rows.select("_id", *numbers), numbers, 0.0)
        near = neighbours.uniqueness(filled.select("_id", F.array(*numbers).alias("v")), "_id", "v")
        found = found.join(near.select("_id", F.col("uniqueness").alias("C19_duplicate_uniqueness")), "_id", "left")
    return found.drop("_id")


def _visual_joint(frames, matches, aligned, most: int = 80):
    """C17: of at most ``most`` colour frames a camera, evenly spaced, brightness against the norm of the matched arm action.

    A frame's action is that of the match with the frame's place among its camera's matches; frames beyond them don't count.
    """
    camera = [*KEYS, "camera"]
    w = W.partitionBy(*camera).orderBy("frame_idx")
    shots = frames.where("stream = 'color'").select(*camera, "frame_idx", "brightness")
    shots = shots.withColumns({"place": F.row_number().over(w) - 1, "n": F.count("*").over(W.partitionBy(*camera))})
    shots = shots.where(F.array_contains(sample_places(F.col("n").cast("int"), most), F.col("place").cast("int")))
    acted = matches.where("stream = 'color'").select(*camera, "k", (F.row_number().over(w) - 1).alias("place"))
    size = aligned.where("stream = 'arm_action'").groupBy(*KEYS, "k").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("motion"))
    both = shots.join(acted, [*camera, "place"]).join(size, [*KEYS, "k"])
    return quality.visual_joint_information(both, KEYS, "camera", "brightness", "motion").withColumnRenamed("C17", "C17_visual_joint_mi")


def bc_samples(store: StageStore, cfg: Config = Config(), mode: str = "arm_effector") -> None:
    """aligned -> bc_samples: windows of the state channels (x) and the action at their end (y).

    ``mode``: "arm_effector" takes the channels of both groups, so a trajectory that lacks one has no windows; "arm_only"
    the arm's. Frames beyond the shortest group's end miss a value and are in no window.
    """
    if mode not in ("arm_only", "arm_effector"):
        raise ValueError("mode is 'arm_only' or 'arm_effector'")
    groups = "arm" if mode == "arm_only" else "arm|effector"
    aligned = store.read("aligned", [*KEYS, "stream", "dim", "k", "v"]).where(F.col("stream").rlike(f"^({groups})_(state|action)$"))
    named = aligned.withColumn("name", F.concat_ws("_", "stream", "dim"))
    names = [r[0] for r in named.select("name").distinct().orderBy("name").collect()]  # the channels
    wide = named.groupBy(*KEYS, "k").pivot("name", names).agg(F.first("v", True))
    x, y = ([n for n in names if f"_{kind}_" in n] for kind in ("state", "action"))
    windows = T.sliding_windows(wide, KEYS, ["k"], x, y, cfg.window, cfg.stride)
    store.write("bc_samples", windows.select(F.concat_ws("_", *KEYS, "i").alias("sample_id"), *KEYS, "x", "y"), ["scene_id"])


def score(store: StageStore, indicator_columns: dict[str, int], dimensions: dict[str, list[str]], scope: str = "scene") -> None:
    """indicators -> indicators_norm, entropy_weights, quality_scores. ``scope``: scale within scenes, or "global"."""
    raw = store.read("indicators", [*KEYS, *indicator_columns])
    norm = store.write("indicators_norm", scoring.minmax(raw, indicator_columns, ["scene_id"] if scope == "scene" else None))
    weights = store.write("entropy_weights", scoring.entropy_weights(norm, list(indicator_columns)))
    store.write("quality_scores", scoring.composite_scores(norm, KEYS, weights, dimensions))


def value(store: StageStore, cfg: Config = Config()) -> None:
    """bc_samples -> delta_all, delta_summary, trajectory_value."""
    samples = store.read("bc_samples", ["sample_id", "scene_id", "trajectory_id", "x", "y"])
    ids = ranking.split_train(samples.select(*KEYS).distinct(), "scene_id", "trajectory_id", cfg.train_share, 0)
    marked = samples.join(ids.select(*KEYS, (F.col("split") == "val").alias("is_val")), KEYS)
    scenes = [r[0] for r in ids.select("scene_id").distinct().orderBy("scene_id").collect()]
    runs = store.write("delta_all", curation.scene_values(marked, scenes, list(cfg.run_seeds), cfg.epochs))
    summary = store.write("delta_summary", curation.delta_stability(runs, ["scene_id"], "seed", "delta_score"))
    found = summary.select("scene_id", F.col("delta_score_mean").alias("delta"))
    store.write("trajectory_value", curation.trajectory_values(ids.select(*KEYS), found, "scene_id"))


JOB = ["strategy", "ratio", "run_seed"]


def curate(store: StageStore, cfg: Config = Config(), strategies: list[str] | None = None) -> None:
    """quality_scores, trajectory_value -> curation_split, curation_scores, curation_selection (only jobs not yet done).

    All pending jobs are marked on the pool's rows in one plan and written at once, partitioned by job, so a repeated or
    interrupted run replaces its own partitions.
    """
    q = store.read("quality_scores", [*KEYS, "Q_score", "Q_accuracy", "Q_consistency"])
    v = store.read("trajectory_value", [*KEYS, "delta"])
    df = q.join(v.select(*KEYS, "delta"), KEYS).withColumn("global_id", F.concat_ws("_", "scene_id", "trajectory_id"))
    split = store.write("curation_split", ranking.split_test_pool(df, "scene_id", "global_id", cfg.test_share, 0))
    scored = store.write("curation_scores", curation.hybrid_scores(split, "Q_score", "Q_accuracy", "Q_consistency", "delta"))
    grid = curation.job_grid(store.spark, strategies or ["full", "random", "high_Q_stratified", *curation.STRATEGIES], list(cfg.ratios), list(cfg.run_seeds), list(cfg.random_seeds))
    done = store.read("curation_selection", optional=True)
    todo = (grid if done is None else curation.pending(grid, done)).orderBy(*JOB).collect()  # the job grid: some hundred rows
    if not todo:
        return
    jobs = [(r["strategy"], float(r["ratio"]), r["run_seed"]) for r in todo]
    marked = curation.mark_selections(scored.where("split = 'pool'"), jobs)
    told = F.broadcast(store.spark.createDataFrame([(i, *j) for i, j in enumerate(jobs)], "job int, strategy string, ratio double, run_seed int"))
    picked = marked.select("global_id", *KEYS, F.inline("picks")).join(told, "job").drop("job")
    store.write("curation_selection", picked, JOB)


def evaluate(store: StageStore, cfg: Config = Config()) -> None:
    """bc_samples, curation_split, curation_selection -> curation_metrics, curation_per_scene, curation_summary (only jobs not yet measured).

    Every selection trains a network on its trajectories' windows and is tested on the windows of the test split. All
    pending jobs train side by side; errors are normalised by the pool's targets.
    """
    chosen = store.read("curation_selection", [*JOB, "global_id"])
    done = store.read("curation_metrics", optional=True)
    grid = chosen.select("strategy", F.col("ratio").cast("decimal(6,4)").alias("ratio"), F.col("run_seed").cast("int").alias("run_seed")).distinct()
    todo = (grid if done is None else curation.pending(grid, done)).orderBy(*JOB).collect()  # the job grid: some hundred rows
    if todo:
        jobs = [(i, r["strategy"], float(r["ratio"]), r["run_seed"]) for i, r in enumerate(todo)]
        told = F.broadcast(store.spark.createDataFrame(jobs, "job int, strategy string, ratio double, run_seed int"))
        same = [chosen["strategy"] == told["strategy"], chosen["ratio"].cast("decimal(6,4)") == told["ratio"].cast("decimal(6,4)"), chosen["run_seed"] == told["run_seed"]]
        belongs = chosen.join(told, same[0] & same[1] & same[2]).groupBy("global_id").agg(F.sort_array(F.collect_set("job")).alias("train"))  # at most the grid's jobs a row
        split = store.read("curation_split", ["global_id", "split"]).select("global_id", "split")
        samples = store.read("bc_samples", ["sample_id", *KEYS, "x", "y"]).withColumn("global_id", F.concat_ws("_", *KEYS))
        rows = samples.join(split, "global_id").join(belongs, "global_id", "left")
        every = F.array(*[F.lit(i) for i, *_ in jobs])
        none = F.array().cast("array<int>")
        rows = rows.select("sample_id", "scene_id", "global_id", "x", "y", "split", F.coalesce("train", none).alias("train"), F.when(F.col("split") == "test", every).otherwise(none).alias("test"))
        rows = scratch(rows, "curation-rows")
        scale = training.target_scale(rows.where("split = 'pool'"))
        trained = training.train_networks(rows, [zlib.crc32(f"{s}|{r:.4f}|{k}".encode()) for _, s, r, k in jobs], epochs=cfg.epochs)
        errors = scratch(training.window_errors(rows, trained, scale, keep=["scene_id", "global_id"]), "curation-errors")
        sizes = rows.select("global_id", F.explode("train").alias("job")).groupBy("job").agg(F.countDistinct("global_id").alias("n_train_trajectories"), F.count("*").alias("n_train_windows"))
        test = {"test_nmse": "normalized_mse", "test_imitation_score": "imitation_score", "test_mae": "mae", "test_mse": "mse"}
        figures = training.imitation(errors, ["job"]).join(sizes, "job").join(told, "job")
        store.write("curation_metrics", figures.select(*JOB, "n_train_trajectories", "n_train_windows", *[F.col(c).alias(n) for n, c in test.items()]), JOB)
        scenes = training.imitation(errors, ["job", "scene_id"]).join(errors.groupBy("job", "scene_id").agg(F.countDistinct("global_id").alias("n_test_trajectories")), ["job", "scene_id"]).join(told, "job")
        scenes = scenes.select(*JOB, F.col("scene_id").alias("test_scene"), "n_test_trajectories", F.col("normalized_mse").alias("scene_nmse"), F.col("imitation_score").alias("scene_imitation_score"), F.col("mae").alias("scene_mae"))
        store.write("curation_per_scene", scenes, JOB)
    store.write("curation_summary", curation.evaluation_summary(store.read("curation_metrics")))


def fold_labels(store: StageStore, cfg: Config = Config()) -> None:
    """bc_samples -> label_folds, trajectory_labels, label_summary: every trajectory is scored by a network that was trained without its fold."""
    samples = store.read("bc_samples", ["sample_id", *KEYS, "x", "y"]).withColumn("global_id", F.concat_ws("_", *KEYS))
    folds = store.write("label_folds", ranking.k_folds(samples.select("global_id", "scene_id").distinct(), "scene_id", "global_id", cfg.folds, 0))
    numbers = F.sequence(F.lit(0), F.lit(cfg.folds - 1))
    rows = samples.join(folds.select("global_id", "fold"), "global_id")
    rows = scratch(rows.select("sample_id", "scene_id", "global_id", "x", "y", F.filter(numbers, lambda f: f != F.col("fold")).alias("train"), F.array("fold").alias("test")), "fold-rows")
    trained = training.train_networks(rows, [zlib.crc32(f"fold|{f}".encode()) for f in range(cfg.folds)], epochs=cfg.epochs)
    errors = training.window_errors(rows, trained, training.target_scale(rows), keep=["scene_id", "global_id"])
    found = store.write("trajectory_labels", labels.trajectory_errors(errors, "global_id", "scene_id", "mse", "mae", "normalized_mse"))
    store.write("label_summary", labels.label_summary(found, "scene_id"))


#: Quality columns whose scene means go into the value model, and those that only do if they vary.
VALUE_FEATURES = ["n_trajectories", "Q_score_mean", "Q_completeness_mean", "Q_accuracy_mean", "Q_diversity_mean", "Q_consistency_mean"]


def meta_value(store: StageStore, alpha: float = 1.0) -> None:
    """quality_scores, delta_summary -> scene_quality, value_correlations, value_loocv, value_metrics, value_predictions, trajectory_value.

    Scenes' quality profiles against their measured values: correlations with p-values, a ridge model scored by leaving one
    scene out, and its fit on all measured scenes, which predicts every scene with a profile. Trajectories of scenes
    without a measured value get the predicted one, and ``value_source`` says which it is. Features that are constant
    over the measured scenes, or missing in some, are left out.
    """
    q = store.read("quality_scores", [*KEYS, "Q_score"])
    names = [c for c in numeric_columns(q, prefix="Q_")]
    profile = store.write("scene_quality", curation.group_profile(q, ["scene_id"], names))
    measured = profile.join(store.read("delta_summary", ["scene_id", "delta_score_mean"]), "scene_id")
    measured = scratch(measured, "value-model")
    candidates = ["n_trajectories", *[f"{c}_{k}" for c in names for k in ("mean", "std", "min", "max")]]
    verdicts = {r["feature"]: r["verdict"] for r in scoring.low_variance(measured.select(*[F.col(c).cast("double").alias(c) for c in candidates]), candidates, dominant=2.0).collect()}  # one row a feature
    varied = [c for c in candidates if verdicts[c] == "keep"]
    n = measured.count()
    if varied:
        found = scoring.correlations(measured, varied, "delta_score_mean")
        p = [scoring.student_p(c, "n").alias(f"{c}_p") for c in ("pearson", "spearman")]
        store.write("value_correlations", found.select("feature", "n", "pearson", p[0], "spearman", p[1], F.abs("pearson").alias("abs_pearson"), F.abs("spearman").alias("abs_spearman")))
    use = [c for c in VALUE_FEATURES if c in varied]
    empirical = measured.select("scene_id", F.col("delta_score_mean").alias("delta"))
    predictions = None
    if use and n > 1:
        loo = models.ridge_folds(measured.select("scene_id", "delta_score_mean", *use), use, "delta_score_mean", "scene_id", alpha)
        loo = store.write("value_loocv", loo.select("scene_id", F.col("delta_score_mean").alias("delta_score_true"), F.col("pred").alias("delta_score_pred"), F.abs(F.col("pred") - F.col("delta_score_mean")).alias("abs_error")))
        store.write("value_metrics", scoring.regression_metrics(loo, [], "delta_score_true", "delta_score_pred").withColumns({"model": F.lit("Ridge_LOOCV"), "alpha": F.lit(float(alpha))}))
        beta, b0 = models.ridge_from_gram(*models.gram(measured, [*use, "delta_score_mean"]), alpha)
        predictions = profile.select("scene_id", sum((F.col(c) * float(b) for c, b in zip(use, beta)), F.lit(float(b0))).alias("pred"))
        predictions = store.write("value_predictions", predictions.join(empirical, "scene_id", "left"))
    store.write("trajectory_value", curation.trajectory_values(q.select(*KEYS), empirical, "scene_id", predictions))


def modeling_table(store: StageStore, target: str = "trajectory_normalized_mse") -> None:
    """trajectory_labels, feature_matrix, quality_scores, trajectory_value -> modeling_table, modeling_check, modeling_features.

    Labelled trajectories with all features, by left joins on the trajectory: nothing fans out, as every side is unique.
    modeling_features lists the nested sets: A trajectory features, B and quality, C and value.
    """
    base = store.read("trajectory_labels", ["global_id", "scene_id", target])
    gid = F.concat_ws("_", *KEYS).alias("global_id")
    sides = {"A": store.read("feature_matrix", KEYS), "B": store.read("quality_scores", KEYS), "C": store.read("trajectory_value", [*KEYS, "delta"]).select(*KEYS, "delta")}
    table, sets = base, {}
    for name, side in sides.items():
        sets[name] = [c for c in numeric_columns(side) if c not in [*KEYS, *table.columns]]
        table = table.join(side.select(gid, *sets[name]).dropDuplicates(["global_id"]), "global_id", "left")
    table = store.write("modeling_table", table)
    every = [c for cols in sets.values() for c in cols]
    gaps = [F.count_if(F.col(c).isNull()) > 0 for c in every]
    check = curation.integrity(table, "global_id", [target])
    with_gaps = table.agg(sum((g.cast("int") for g in gaps), F.lit(0)).alias("n_feature_cols_with_na")).withColumn("n_feature_cols", F.lit(len(every)))
    store.write("modeling_check", scoring.beside(check, with_gaps))
    nested = [(config, c) for i, config in enumerate("ABC") for name in "ABC"[: i + 1] for c in sets[name]]
    store.write("modeling_features", store.spark.createDataFrame(nested, "config string, feature string"))


def regression(store: StageStore, cfg: Config = Config(), target: str = "trajectory_normalized_mse", alpha: float = 1.0) -> None:
    """modeling_table, modeling_features -> regression_predictions, regression_folds, regression_dropped, regression_summary, regression_importance.

    Ridge with every feature set under two protocols, random folds and leaving one scene out; and importances of the fit on all rows.
    """
    table = store.read("modeling_table", ["global_id", "scene_id", target])
    table = scratch(ranking.k_folds(table, None, "global_id", cfg.folds, 42).withColumn("random_kfold", F.col("fold").cast("string")).drop("fold").withColumn("leave_one_scene", F.col("scene_id").cast("string")), "regression-rows")
    sets: dict[str, list[str]] = {}
    for r in store.read("modeling_features").orderBy("config", "feature").collect():  # one row a feature and set
        sets.setdefault(r["config"], []).append(r["feature"])
    predictions, folds, dropped, importances = [], [], [], []
    for config, features in sets.items():
        named = {"config": F.lit(config), "model": F.lit("ridge")}
        for protocol in ("random_kfold", "leave_one_scene"):
            found = validation.cross_validate(table, ["global_id"], features, target, protocol, alpha)
            for frame, into in zip(found, (predictions, folds, dropped)):
                into.append(frame.withColumns({"protocol": F.lit(protocol), **named}))
        judged = scoring.low_variance(table.select(*[F.col(c).cast("double").alias(c) for c in features]), features)
        keep = sorted(r["feature"] for r in judged.where("verdict = 'keep'").collect())
        if keep:
            importances.append(models.importance(models.impute_median(table, keep, 0.0), keep, target, alpha).withColumns(named))
    store.write("regression_predictions", curation.stack(predictions))
    store.write("regression_dropped", curation.stack(dropped))
    store.write("regression_summary", validation.cv_summary(store.write("regression_folds", curation.stack(folds)), ["protocol", "config", "model"]))
    if importances:
        store.write("regression_importance", curation.stack(importances))


def causal_effects(
    store: StageStore, covariates: list[str], outcomes: list[str] | dict[str, int], sources: list[str], quantiles: tuple[float, ...] = (0.5, 0.6), cfg: Config = Config(), groups: dict[str, list[str] | None] | None = None
) -> None:
    """curation_scores, and trajectory_labels where they exist -> causal_cells, causal_pairs, causal_effects, causal_balance, causal_robustness.

    Every treatment (a source at or over a quantile) in every group of scenes ("all" and those of ``groups``) on every
    outcome; ``outcomes`` may name the direction that is better (1 or -1). Cells that can't be estimated are in
    causal_cells with the reason.
    """
    df = store.read("curation_scores", ["global_id", "scene_id", *sources])
    found = store.read("trajectory_labels", optional=True)
    if found is not None:
        df = df.join(found.drop(*[c for c in found.columns if c in df.columns and c != "global_id"]), "global_id", "left")
    df = scratch(causal.treatments(require_columns(df, [*covariates, *outcomes]), sources, list(quantiles)), "causal-scores")
    names = {f"t_{s}_q{round(q * 100)}": s for s in sources for q in quantiles}
    signs = outcomes if isinstance(outcomes, dict) else dict.fromkeys(outcomes, 1)
    made = effects.estimate(df, "global_id", "scene_id", names, covariates, signs, {"all": None, **(groups or {})}, cfg.min_rows)
    store.write("causal_cells", made.cells)
    store.write("causal_pairs", made.pairs)
    store.write("causal_robustness", effects.robustness(store.write("causal_effects", made.effects)))
    store.write("causal_balance", made.balance)


__all__ = ["Config", "align", "bc_samples", "causal_effects", "curate", "effector", "evaluate", "features", "fold_labels", "indicators", "label", "meta_value", "modeling_table", "regression", "score", "value"]
