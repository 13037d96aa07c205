"""Operators that no task holds whole: Gram matrices, matching, bootstrap, nearest neighbours, training, selections; against NumPy."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.operators import curation, matching, models, neighbours, quality, training


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- Gram matrices and PCA ---


def ranks(v):
    _, inverse, counts = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2.0)[inverse]


def test_vector_gram_over_blocks_and_levels(spark):
    x = np.random.default_rng(0).normal(size=(200, 7))
    rows = [([float(v) for v in r],) for r in x] + [(None,), ([1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0],)]
    df = frame(spark, rows, "v array<double>").repartition(9)
    for block, fan_in in ((256, 16), (3, 2)):
        n, s, p = models.vector_gram(df, "v", block, fan_in)
        assert n == 200 and np.allclose(s, x.sum(0)) and np.allclose(p, x.T @ x)
    assert models.vector_gram(df.limit(0), "v")[0] == 0.0


def robustness(x, score, target=0.9):
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    order = np.argsort(values)[::-1]
    evr, load = values[order] / values.sum(), vectors[:, order].T
    k = min(int(np.searchsorted(np.cumsum(evr), target)) + 1, len(evr))
    out, mixed = [], np.zeros(len(x))
    for i in range(k):
        pc = centred @ (load[i] * (-1 if load[i].sum() < 0 else 1))
        rho = np.corrcoef(ranks(pc), ranks(score))[0, 1]
        unit = (pc - pc.min()) / (pc.max() - pc.min())
        mixed += (unit if rho >= 0 else 1 - unit) * evr[i] / evr[:k].sum()
        out.append((i + 1, evr[i], np.cumsum(evr)[i], abs(rho)))
    return [(0, 1.0, 1.0, np.corrcoef(ranks(mixed), ranks(score))[0, 1]), *out]


def test_pca_robustness_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 12)) @ rng.normal(size=(12, 12))
    score = np.round(x[:, 0] + rng.normal(size=150), 1)  # ties
    df = frame(spark, [(float(s), [float(v) for v in r]) for s, r in zip(score, x)], "Q double, v array<double>")
    got = [tuple(r) for r in quality.pca_robustness(df, "v", "Q").orderBy("component").collect()]
    want = robustness(x, score)
    assert len(got) == len(want) and np.allclose(got, want, atol=1e-8)
    wide = df.select("Q", *[F.col("v")[i].alias(f"x{i}") for i in range(12)])
    assert np.allclose([tuple(r) for r in quality.pca_robustness(wide, [f"x{i}" for i in range(12)], "Q").orderBy("component").collect()], want, atol=1e-8)
    gaps = df.union(frame(spark, [(None, [0.0] * 12), (1.0, None)], "Q double, v array<double>"))
    assert np.allclose([tuple(r) for r in quality.pca_robustness(gaps, "v", "Q").orderBy("component").collect()], want, atol=1e-8)
    assert quality.pca_robustness(df.limit(0), "v", "Q").count() == 0


def test_pca_of_a_thousand_dimensions(spark):
    df = spark.range(60).select(F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.sin(F.col("id") * (i % 17 + 1) + i)).alias("v"), F.sin("id").alias("Q"))
    got = quality.pca_robustness(df, "v", "Q").collect()
    assert len(got) > 2 and abs(got[0]["evr"] - 1.0) < 1e-9 and all(0 <= r["spearman"] <= 1 for r in got[1:])


# --- Matching ---


def closest_first(units, caliper):
    """Greedy on atoms: the closest pair of free atoms of two arms again and again; ids of an atom go smallest first."""
    free = {}
    for i, t, z in units:
        free.setdefault((z, t), []).append(i)
    free = {k: sorted(v) for k, v in free.items()}
    pairs = []
    while True:
        best = min(((abs(a[0] - b[0]), min(a[0], b[0])) + (a, b) for a in free if a[1] == 1 and free[a] for b in free if b[1] == 0 and free[b]), default=None)
        if best is None or best[0] > caliper:
            return sorted(pairs)
        _, _, a, b = best
        pairs.append((free[a].pop(0), free[b].pop(0)))


@pytest.mark.parametrize("grid, most", [(1000, 0), (1000, 10**5), (12, 0), (12, 10**5)])
def test_closest_pairs_equal_greedy(spark, grid, most, monkeypatch):
    """A fine grid has hardly a tie; of a coarse one every atom holds many units. By slices, and in a task a scene."""
    monkeypatch.setattr(matching, "MOST_ATOMS", most)
    rng = np.random.default_rng(grid)
    rows, want = [], []
    for scene in ("a", "b", None):
        units = [(int(i) + 1000 * len(scene or "long"), int(rng.integers(2)), float(rng.integers(1, grid)) / grid) for i in range(45)]
        rows += [(scene, i, t, p) for i, t, p in units]
    df = frame(spark, rows, "scene string, id int, t int, p double").dropDuplicates(["id"])
    rows = [tuple(r) for r in df.collect()]
    z = {i: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6))) for _, i, _, p in rows}
    caliper = 0.2 * float(np.std([z[i] for _, i, _, _ in rows], ddof=1))
    for scene in ("a", "b", None):
        want += closest_first([(i, t, z[i]) for s, i, t, _ in rows if s == scene], caliper)
    got = matching.closest_pairs(df.repartition(5), "scene", "id", "t").collect()
    close = sorted((r["treated_id"], r["control_id"]) for r in got)
    if grid == 1000:
        assert close == sorted(want)
    assert len(close) == len(want) and len({t for t, _ in close}) == len(close) == len({c for _, c in close})
    assert np.isclose(sum(r["distance"] for r in got), sum(abs(z[a] - z[b]) for a, b in want), rtol=1e-6)
    arm = {i: (s, t) for s, i, t, _ in rows}
    assert all(arm[r["treated_id"]] == (r["scene"], 1) and arm[r["control_id"]] == (r["scene"], 0) and abs(z[r["treated_id"]] - z[r["control_id"]]) <= caliper + 1e-12 for r in got)


def test_closest_pairs_edges(spark):
    schema = "scene string, id int, t int, p double"
    same = frame(spark, [("s", i, int(i < 3000), 0.5 if i % 2 else 0.4) for i in range(5000)], schema)
    got = matching.closest_pairs(same, "scene", "id", "t", caliper_ratio=0.1).collect()
    assert len(got) == 2000 and {r["distance"] for r in got} == {0.0}
    assert matching.closest_pairs(same.where("t = 1"), "scene", "id", "t").count() == 0
    assert matching.closest_pairs(same.limit(0), "scene", "id", "t").count() == 0
    odd = frame(spark, [("s", 1, 1, None), ("s", 2, None, 0.5), (None, 3, 1, 0.5), (None, 4, 0, 0.52), ("s", 5, 0, 0.5)], schema)
    assert [tuple(r)[:3] for r in matching.closest_pairs(odd, "scene", "id", "t", caliper_ratio=10.0).collect()] == [(None, 3, 4)]


# --- Bootstrap ---


def test_bootstrap_effects_equal_plain_python_and_near_the_classic_interval(spark):
    d = np.random.default_rng(1).normal(1.0, 2.0, size=80)
    df = frame(spark, [("y", i, float(x)) for i, x in enumerate(d)] + [("z", 1, 5.0), ("y", 99, None)], "outcome string, treated_id int, diff double").repartition(6)
    got = {r["outcome"]: r for r in matching.bootstrap_effects(df, ["outcome"], n_boot=300).collect()}
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    means = []
    for rep in range(300):
        u = np.array([int(hashlib.md5(f"42|{rep // 4}|{i}".encode()).hexdigest()[8 * (rep % 4) : 8 * (rep % 4) + 8], 16) / 2**32 for i in range(80)])
        w = (u[:, None] >= upto[None, :]).sum(1)
        means.append((w * d).sum() / w.sum())
    low, high = np.percentile(means, [2.5, 97.5])
    assert np.allclose([got["y"]["att"], got["y"]["ci_low"], got["y"]["ci_high"]], [d.mean(), low, high]) and got["y"]["n_pairs"] == 80
    rng = np.random.RandomState(0)
    classic = np.percentile([d[rng.randint(0, 80, 80)].mean() for _ in range(4000)], [2.5, 97.5])
    assert np.allclose([low, high], classic, atol=0.25 * (classic[1] - classic[0]) / 2)
    assert got["z"]["ci_low"] == got["z"]["att"] == 5.0
    assert matching.bootstrap_effects(df.limit(0), ["outcome"]).count() == 0
    assert matching.bootstrap_effects(df.where("outcome = 'z'"), []).first()["att"] == 5.0


def test_bootstrap_draws_an_id_once_for_all_its_groups(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"g{g}" if g else None, None if i == 7 else i, float(rng.normal())) for g in range(30) for i in range(40)]
    drawn, draw = spark.sparkContext.accumulator(0), matching.poisson_weights

    def counted(ids, *rest):
        drawn.add(len(ids))
        return draw(ids, *rest)

    monkeypatch.setattr(matching, "poisson_weights", counted)
    monkeypatch.setattr(matching, "MOST_GROUPS", 7)
    got = {r["g"]: r for r in matching.bootstrap_effects(frame(spark, rows, "g string, id int, d double").repartition(5), ["g"], "id", "d", n_boot=30).collect()}
    assert drawn.value == 40 and len(got) == 30
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    ids = ["" if i == 7 else f"|{i}" for i in range(40)]
    u = np.array([[int(hashlib.md5(f"42|{rep // 4}{i}".encode()).hexdigest()[8 * (rep % 4) : 8 * (rep % 4) + 8], 16) / 2**32 for i in ids] for rep in range(30)])
    w = (u[:, :, None] >= upto).sum(2)
    for g in range(30):
        d = np.array([x for name, _, x in rows if name == (f"g{g}" if g else None)])
        r = got[f"g{g}" if g else None]
        assert np.allclose([r["att"], r["ci_low"], r["ci_high"]], [d.mean(), *np.percentile(w @ d / w.sum(1), [2.5, 97.5])]) and r["n_pairs"] == 40
    whole = matching.bootstrap_effects(frame(spark, rows, "g string, id int, d double").where("g = 'g3'").drop("g"), [], "id", "d", n_boot=30).first()
    assert [whole[c] for c in ("att", "ci_low", "ci_high")] == pytest.approx([got["g3"][c] for c in ("att", "ci_low", "ci_high")])


# --- Nearest neighbours ---


@pytest.mark.parametrize("tile", [7, 2000])
def test_nearest_is_exact_and_skips_most_pairs(spark, tile):
    rng = np.random.default_rng(5)
    n = 300 if tile == 7 else 2000
    x = np.repeat(rng.normal(0, 50, size=(20, 4)), n // 20, axis=0) + rng.normal(size=(n, 4))
    x[:5] = x[5]  # ties
    df = frame(spark, [(f"r{i}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, v array<double>").repartition(4)
    got = {r["id"]: r for r in neighbours.nearest(df, "id", "v", tile, small=0).collect()}
    plain = {r["id"]: r["distance"] for r in neighbours.nearest(df, "id", "v", tile).collect()}
    assert plain.keys() == got.keys() and all(math.isclose(plain[i], got[i]["distance"], abs_tol=1e-9) for i in got)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.diag([np.inf] * n)
    assert len(got) == n and np.allclose([got[f"r{i}"]["distance"] for i in range(n)], d.min(1))
    if n == 2000:
        assert sum(r["compared"] for r in got.values()) < 0.15 * n * n


def test_nearest_edges(spark):
    df = frame(spark, [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [3.0, 5.0])], "id int, v array<double>")
    for small in (0, 100):
        got = sorted((r["distance"] for r in neighbours.nearest(df, "id", "v", small=small).collect()))
        assert np.allclose(got, [0.0, 0.0, 5.0])
    assert neighbours.nearest(df.limit(1), "id", "v", small=0).first()["distance"] is None
    assert neighbours.nearest(df.limit(1), "id", "v").first()["distance"] is None and neighbours.nearest(df.limit(0), "id", "v").count() == 0
    z = frame(spark, [(i, [float(i * i), 3.0]) for i in range(6)], "id int, v array<double>")
    v = np.array([i * i for i in range(6)], float)
    v = (v - v.mean()) / v.std(ddof=1)
    near = np.min(np.abs(v[:, None] - v[None]) + np.diag([np.inf] * 6), 1)
    got = {r["id"]: r["uniqueness"] for r in neighbours.uniqueness(z, "id", "v").collect()}
    assert np.allclose([got[i] for i in range(6)], near / near.max())


def test_nearest_moves_no_row_to_every_cell(spark, monkeypatch):
    """Elements that don't depend on each other leave the index nothing to rule out; copies are at distance 0."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 40))
    x[:60], x[60] = x[100], x[101] + 1e-9
    df = frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>").repartition(3)
    stored, plain = [], neighbours.scratch
    monkeypatch.setattr(neighbours, "scratch", lambda rows, label, *a: stored.append(out := plain(rows, label, *a)) or out)
    got = {r["id"]: r["distance"] for r in neighbours.nearest(df, "id", "v", small=0).collect()}
    assert max(t.count() for t in stored) <= len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.diag([np.inf] * len(x))
    assert [got[i] for i in range(len(x))] == pytest.approx(d.min(1).tolist(), rel=1e-12, abs=1e-15)
    for wide in (0, 10**7):  # blocks that hardly differ, far from 0
        y = wide + np.round(rng.normal(size=(90, 3)), 6)
        near = np.full(40, np.inf), np.full(50, np.inf)
        neighbours.nearest_between(y[:40], y[40:], *near)
        d = np.sqrt(((y[:40, None] - y[None, 40:]) ** 2).sum(2))
        assert (near[0] == d.min(1)).all() and (near[1] == d.min(0)).all()


def test_k_means_and_medians_of_columns_with_gaps(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.repeat([[0.0, 0.0], [9.0, 0.0], [0.0, 9.0]], 40, axis=0) + rng.normal(size=(120, 2))
    df = frame(spark, [(i, *map(float, r), None if i % 5 else float(i)) for i, r in enumerate(x)], "id int, a double, b double, c double").repartition(3)
    asked, plain = [], models.table_quantiles
    monkeypatch.setattr(models, "table_quantiles", lambda rows, wanted: asked.append(list(wanted)) or plain(rows, wanted))
    filled = models.impute_median(df, ["a", "b", "c"], 0.0)
    assert asked == [["c"]] and {r["c"] for r in filled.collect() if r["id"] % 5} == {57.5}
    assert models.impute_median(df, ["a", "b"], 0.0).count() == 120 and len(asked) == 1
    got = {r["id"]: r["cluster"] for r in models.k_means(df, ["a", "b"], 3, 1, "id").collect()}
    means = np.array([x[[i for i in got if got[i] == k]].mean(0) for k in range(3)])
    assert [got[i] for i in range(120)] == ((x[:, None] - means[None]) ** 2).sum(2).argmin(1).tolist()


# --- Training ---


def samples_of(spark, n=240, parts=5):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 3))
    y = np.stack([x[:, 0] - x[:, 1], x[:, 2] ** 2], 1)
    rows = [(f"s{i}", [float(v) for v in x[i]], [float(v) for v in y[i]], [j for j in range(3) if i % 3 != j], [i % 3]) for i in range(n)]
    return x, y, frame(spark, rows, "sample_id string, x array<double>, y array<double>, train array<int>, test array<int>").repartition(parts)


def test_training_equals_full_batch_numpy(spark, monkeypatch):
    x, y, df = samples_of(spark)
    monkeypatch.setattr(training, "FAN_IN", 2)
    trained = training.train_networks(df, [11, 12, 13], hidden=16, epochs=6)
    for j, seed in enumerate((11, 12, 13)):
        at = np.arange(len(x)) % 3 != j
        model = models.train_mlp(x[at], y[at], seed, hidden=16, epochs=6, batch=10**6)
        assert np.abs(trained.predict(j, x) - model(x)).max() < 1e-6
    errors = training.window_errors(df, trained, training.target_scale(df), keep=["sample_id"]).collect()
    assert len(errors) == len(x) and {r["job"] for r in errors} == {0, 1, 2}
    i = int(errors[0]["sample_id"][1:])
    assert math.isclose(errors[0]["mse"], ((trained.predict(i % 3, x[i : i + 1]) - y[i]) ** 2).mean(), rel_tol=1e-9)


def test_training_learns_in_steps_and_skips_empty_jobs(spark):
    x, y, df = samples_of(spark)
    trained = training.train_networks(df, [1, 2, 3, 4], hidden=32, epochs=40, batch=60, rate=1e-2)
    assert trained.known == {0, 1, 2}
    base = ((y - y.mean(0)) ** 2).mean()
    assert ((trained.predict(0, x) - y) ** 2).mean() < 0.2 * base
    nobody = training.train_networks(df.withColumn("train", F.array().cast("array<int>")), [1])
    assert nobody.known == set() and training.window_errors(df.where("false"), nobody, [1.0, 1.0]).count() == 0


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    net = training.Network(3, 2, 5)
    flat, x, y = net.start(1) + rng.normal(size=net.edges[-1]) / 10, rng.normal(size=(9, 3)), rng.normal(size=(9, 2))
    loss = lambda f: ((net.forward(net.parts(f), x)[0] - y) ** 2).sum()
    got = net.gradient(flat, x, y)
    for i in rng.integers(0, len(flat), 25):
        e = np.zeros(len(flat))
        e[i] = 1e-6
        assert abs(got[i] - (loss(flat + e) - loss(flat - e)) / 2e-6) < 1e-4


def test_gradient_in_chunks_and_single_precision():
    rng = np.random.default_rng(1)
    net, n = training.Network(5, 2, 16), 2 * training.CHUNK + 7
    flat, x, y = net.start(3), rng.normal(size=(n, 5)), rng.normal(size=(n, 2))
    one = sum(net.gradient(flat, x[i : i + 1], y[i : i + 1]) for i in range(n))
    assert np.allclose(net.gradient(flat, x, y), one, rtol=1e-9, atol=1e-9)
    assert np.abs(net.gradient(flat, x, y, np.float32) - one).max() < 1e-4 * np.abs(one).max()
    assert net.gradient(flat, x[:0], y[:0]).tolist() == [0.0] * len(flat)


def test_gradient_of_weighted_rows():
    rng = np.random.default_rng(6)
    for n_out, hidden in ((1, 24), (3, 7)):
        net, n = training.Network(4, n_out, hidden), training.CHUNK + 9
        flat, x, y, w = net.start(5) + rng.normal(size=net.edges[-1]) / 10, rng.normal(size=(n, 4)), rng.normal(size=(n, n_out)), rng.integers(1, 5, n)
        want = net.gradient(flat, np.repeat(x, w, 0), np.repeat(y, w, 0))
        assert np.allclose(net.gradient(flat, x, y, weight=w), want, rtol=1e-9, atol=1e-9)
        assert np.abs(net.gradient(flat, x, y, np.float32, w) - want).max() < 1e-4 * np.abs(want).max()


@pytest.mark.parametrize("batch", [10**6, 70])
def test_equal_training_rows_are_stored_once(spark, monkeypatch, batch):
    """Seven copies of every row: one row of weight seven in a full batch, at most one a step in mini-batches; the networks are those of all rows."""
    stored, plain = [], training.scratch
    monkeypatch.setattr(training, "scratch", lambda rows, *a: stored.append(plain(rows, *a)) or stored[-1])
    x, y, df = samples_of(spark, 60)
    copies = df.crossJoin(spark.range(7)).withColumn("sample_id", F.concat("sample_id", F.lit("-"), "id")).drop("id").repartition(4)
    many = training.train_networks(copies, [1, 2, 3], hidden=8, epochs=5, batch=batch)
    rows, dealt = stored[0].count(), stored[0].agg(F.sum("weight")).first()[0]
    if batch > 420:
        once = training.train_networks(df, [1, 2, 3], hidden=8, epochs=5, batch=batch)
        assert (rows, dealt) == (60, 420) and np.allclose(once.scales, many.scales) and np.abs(once.predict(1, x) - many.predict(1, x)).max() < 1e-6
        return
    assert 60 <= rows < 400 and dealt == 420
    # by hand: the same steps over all copies, one by one
    net, j = training.Network(3, 2, 8), 1
    told = copies.withColumn("step", F.pmod(F.xxhash64("sample_id"), F.lit(6))).where(F.array_contains("train", j)).toPandas()
    a, b, step = np.array(told["x"].tolist()), np.array(told["y"].tolist()), told["step"].to_numpy()
    a, b = (a - a.mean(0)) / a.std(0), (b - b.mean(0)) / b.std(0)
    flat, m, v = net.start(2), 0.0, 0.0
    for t in range(1, 31):
        at = step == (t - 1) % 6
        g = net.gradient(flat, a[at], b[at]) / (at.sum() * 2)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat * (1 - 1e-3 * 1e-5) - 1e-3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.abs(many.params[j] - flat).max() < 1e-3 and np.abs(many.params[j] - net.start(2)).max() > 1e-2


# --- Selections ---


def test_marked_selections_equal_single_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(f"g{i:03d}", f"S{i % 3}", None if i % 11 == 0 else float(rng.integers(12)), float(rng.integers(5)), float(i % 7)) for i in range(83)]
    pool = frame(spark, rows, "global_id string, scene_id string, Q_score double, hybrid_score_Q double, delta double")
    jobs = [("full", 1.0, 0), *[(s, r, k) for s in ("random", "high_Q_global", "low_Q_score", "high_Q_stratified", "hybrid_Q_delta", "high_delta") for r in (0.2, 0.5, 1.0) for k in (0, 3)]]
    marked = curation.mark_selections(pool.repartition(5), jobs).select("global_id", F.inline("picks"))
    got = {}
    for r in marked.collect():
        got.setdefault(r["job"], {})[r["global_id"]] = (r["selected_rank"], r["selection_score"])
    for i, (strategy, ratio, seed) in enumerate(jobs):
        want = {r["global_id"]: r["selection_score"] for r in curation.select_ids(pool, strategy, ratio, seed).collect()}
        if strategy == "full":
            want = dict.fromkeys(want, 1.0)
        assert {g: s for g, (_, s) in got[i].items()} == want, (strategy, ratio)
        if strategy != "high_Q_stratified":
            assert sorted(p for p, _ in got[i].values()) == list(range(1, len(want) + 1))
    with pytest.raises(ValueError):
        curation.mark_selections(pool, [("best", 0.5, 0)])


def test_evaluation_summary(spark):
    rows = [("full", 1.0, 0, 0.8, 0.5), ("random", 0.5, 0, 1.0, 0.4), ("random", 0.5, 1, 3.0, 0.2), ("high", 0.5, 0, 1.0, 0.3), ("high", 0.25, 0, 1.0, 0.3)]
    m = frame(spark, rows, "strategy string, ratio double, run_seed int, test_nmse double, test_imitation_score double")
    got = {(r["strategy"], r["ratio"]): r for r in curation.evaluation_summary(m).collect()}
    assert got["high", 0.5]["relative_to_random_nmse_mean"] == 0.5 and got["high", 0.5]["relative_to_full_nmse_mean"] == pytest.approx(-0.25)
    assert got["high", 0.25]["relative_to_random_nmse_mean"] is None and got["random", 0.5]["n_runs"] == 2 and got["random", 0.5]["test_nmse_std"] == pytest.approx(2**0.5)


# --- Effects of many cells ---


def test_effects_of_all_cells_equal_single_runs(spark):
    from kinetrail.operators import causal, effects

    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        a, b = float(rng.normal()), None if i % 13 == 0 else float(rng.normal())
        q = a + (b or 0) / 2 + float(rng.normal())
        rows.append((f"g{i:04d}", f"S{i % 4}", a, b, q, int(q > 0.2), int(a > 1e9), 2.0 * q + a + float(rng.normal()), -q))
    df = spark.createDataFrame(rows, "gid string, scene string, a double, b double, q double, t1 int, t2 int, y double, z double").repartition(6)
    found = effects.estimate(df, "gid", "scene", {"t1": "q", "t2": "a"}, ["a", "b", "q"], {"y": 1, "z": -1}, {"all": None, "some": ["S0", "S1"], "none": ["S9"]}, n_boot=50)
    told = {(r["treatment"], r["heterogeneity_group"]): r for r in found.cells.collect()}
    assert told["t1", "all"]["status"] == "ok" and told["t1", "all"]["confounders"] == ["a", "b"] and told["t2", "all"]["status"] == "one_arm" and told["t1", "none"]["status"] == "too_few_rows"
    pairs = {}
    for r in found.pairs.collect():
        pairs.setdefault((r["treatment"], r["heterogeneity_group"]), []).append(r)
    assert set(pairs) == {("t1", "all"), ("t1", "some")}
    for group, scenes in (("all", None), ("some", ["S0", "S1"])):
        own = df if scenes is None else df.where(F.col("scene").isin(*scenes))
        p = models.propensity(own, ["a", "b"], "t1")
        want = matching.closest_pairs(p, "scene", "gid", "t1").collect()
        got = pairs["t1", group]
        assert sorted((r["treated_id"], r["control_id"]) for r in got) == sorted((r["treated_id"], r["control_id"]) for r in want)
        y = {r["gid"]: (r["y"], r["z"]) for r in own.collect()}
        for k, (outcome, sign) in enumerate((("y", 1), ("z", -1))):
            effect = found.effects.where((F.col("heterogeneity_group") == group) & (F.col("outcome") == outcome)).first()
            att = np.mean([y[r["treated_id"]][k] - y[r["control_id"]][k] for r in want])
            assert math.isclose(effect["att_raw"], att) and math.isclose(effect["att_beneficial_direction"], sign * att) and effect["n_treated_matched"] == len(want)
            assert effect["ci95_lo_beneficial"] <= effect["att_beneficial_direction"] <= effect["ci95_hi_beneficial"]
        before = {r["covariate"]: r["smd"] for r in causal.balance(own, ["a", "b"], "t1").collect()}
        ids = {x for r in want for x in (r["treated_id"], r["control_id"])}
        after = {r["covariate"]: r["smd"] for r in causal.balance(own.where(F.col("gid").isin(*ids)), ["a", "b"], "t1").collect()}
        for r in found.balance.where(F.col("heterogeneity_group") == group).collect():
            assert math.isclose(r["smd_before"], before[r["covariate"]], rel_tol=1e-9) and math.isclose(r["smd_after"], after[r["covariate"]], rel_tol=1e-9)
    assert effects.robustness(found.effects).count() == 4


# --- Quantiles by group, p-values ---


def test_group_quantiles_with_a_hot_group(spark):
    from kinetrail.operators.order import group_quantiles

    rng = np.random.default_rng(9)
    values = {"hot": np.round(rng.normal(size=4000), 2), "tied": np.repeat(3.0, 1500), "long": rng.exponential(size=1200) ** 4, **{f"g{i}": rng.normal(size=rng.integers(1, 6)) for i in range(300)}}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("empty", None), (None, 1.0), (None, 2.0), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    wanted = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    for most in (100, 10**6):
        got = {r["g"]: r["quantiles"] for r in group_quantiles(df, ["g"], "v", wanted, most=most, parts=8, accuracy=50 if most == 100 else 10_000).collect()}
        assert got["empty"] is None and np.allclose(got[None], np.quantile([1.0, 2.0], wanted)) and len(got) == len(values) + 2
        for g, vs in values.items():
            assert np.allclose(got[g], np.quantile(vs, wanted)), g
    assert group_quantiles(df.limit(0), ["g"], "v", wanted).count() == 0


def test_student_p(spark):
    from kinetrail.operators.scoring import student_p

    rows = [(0.5, 10), (-0.5, 10), (0.0, 7), (1.0, 5), (0.99, 3), (0.3, 400), (0.2, 2), (None, 9)]
    got = [r["p"] for r in spark.createDataFrame(rows, "r double, n int").select(student_p("r", "n").alias("p")).collect()]

    def tail(r, n):  # the t density, added up
        k, t = n - 2, abs(r) * math.sqrt((n - 2) / (1 - r * r))
        # x = sqrt(k) tan(a): the integral over a of cos(a) ** (k - 1)
        a = np.linspace(math.atan(t / math.sqrt(k)), math.pi / 2, 400_001)
        f = np.cos(a) ** (k - 1)
        whole = math.sqrt(math.pi) * math.gamma(k / 2) / math.gamma((k + 1) / 2) if k < 300 else math.sqrt(math.pi) * math.exp(math.lgamma(k / 2) - math.lgamma((k + 1) / 2))
        return 2 * float(((f[1:] + f[:-1]) / 2 * np.diff(a)).sum()) / whole

    for i, (r, n) in enumerate(rows[:6]):
        assert math.isclose(got[i], 0.0 if r == 1.0 else tail(r, n), rel_tol=1e-6, abs_tol=1e-12), (r, n)
    assert got[6] is None and got[7] is None


# --- Commits ---


def test_commits_survive_a_dead_writer(spark, tmp_path, monkeypatch):
    from kinetrail.sources.store import StageStore

    store = StageStore(spark, str(tmp_path))
    assert store.committed("runs") is None
    assert store.commit("runs", spark.range(3), "job=1") and not store.commit("runs", spark.range(3), "job=1")
    dead = StageStore(spark, str(tmp_path))

    class Dies:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == "create":
                raise KeyboardInterrupt
            return getattr(self.fs, name)

    whole = dead._files()
    monkeypatch.setattr(dead, "_files", lambda: (Dies(whole[0]), whole[1]))
    with pytest.raises(KeyboardInterrupt):
        dead.commit("runs", spark.range(5), "job=2")  # rows are written, nothing is published
    assert store.committed("runs").count() == 3
    assert store.commit("runs", spark.range(4).withColumn("more", F.lit(1)), "job=2") and store.committed("runs", ["id", "more"]).count() == 7
    with pytest.raises(ValueError):
        store.commit("runs", spark.range(1), "../x")


# --- Small helpers ---


def test_store_info_csv_and_text(spark, tmp_path):
    from kinetrail.functions.columns import text_of, unique_sheet_names
    from kinetrail.sources.store import StageStore

    store = StageStore(spark, str(tmp_path))
    rows = [("a", "t1", 1.5), ("a", "t1", None), ("b", "t2", 2.0)]
    df = spark.createDataFrame(rows, "scene_id string, trajectory_id string, v double")
    store.write("frames", df)
    assert {(r["trajectory_id"], r["n_frames"]) for r in store.trajectory_info("frames", ["scene_id", "trajectory_id"]).collect()} == {("t1", 2), ("t2", 1)}
    store.export_csv("frames_csv", df)
    back = store.import_csv("frames_csv", "scene_id string, trajectory_id string, v double").collect()
    assert sorted(map(str, back)) == sorted(map(str, df.collect()))
    texts = spark.createDataFrame([(b"ok \xc3\xa9",), (b"\xff\xfe",), (None,)], "b binary").select(text_of("b").alias("t")).collect()
    assert [r["t"] for r in texts] == ["ok é", None, None]
    names = spark.createDataFrame([(i, "x" * 40 if i < 12 else "a/b") for i in range(14)], "i int, n string")
    got = [r["sheet"] for r in unique_sheet_names(names, "n", "i").orderBy("i").collect()]
    assert got[0] == "x" * 31 and got[1] == "x" * 29 + "_1" and got[11] == "x" * 28 + "_11" and got[12:] == ["a_b", "a_b_1"] and len(set(got)) == 14


def test_archives_over_the_limit_are_rows(spark, tmp_path, monkeypatch):
    from kinetrail.sources import recordings

    monkeypatch.setattr(recordings, "MAX_BYTES", 10)
    (tmp_path / "large.tar").write_bytes(b"x" * 50)
    (tmp_path / "small.tar").write_bytes(b"x" * 5)
    got = {r["archive"].rsplit("/", 1)[1]: r["error"] for r in recordings.archive_members(spark, str(tmp_path)).collect()}
    assert got["large.tar"] == "over 10 bytes" and got["small.tar"] and got["small.tar"] != "over 10 bytes"


def test_prediction_metrics_and_fold_summary(spark):
    from kinetrail.operators.scoring import fold_summary, prediction_metrics

    rng = np.random.default_rng(1)
    y, p = rng.normal(size=50), np.round(rng.normal(size=50), 1)
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(y, p)] + [("a", None, 1.0), ("b", 1.0, 2.0)], "g string, y double, p double")
    got = {r["g"]: r for r in prediction_metrics(df, ["g"], "y", "p").collect()}
    assert got["a"]["n"] == 50 and math.isclose(got["a"]["spearman"], np.corrcoef(ranks(y), ranks(p))[0, 1]) and got["b"]["spearman"] is None and got["b"]["r2"] is None
    folds = spark.createDataFrame([("m", 0, 1.0), ("m", 1, 3.0), ("k", 0, None)], "m string, fold int, mae double")
    got = {r["m"]: r for r in fold_summary(folds, ["m"], "fold", ["mae"]).collect()}
    assert got["m"]["mae_mean"] == 2.0 and math.isclose(got["m"]["mae_std"], 2**0.5) and got["k"]["mae_mean"] is None


# --- Cross-validation ---


def test_cross_validation_fits_on_training_folds_only(spark):
    from kinetrail.operators import validation

    rng = np.random.default_rng(12)
    n = 90
    x = rng.normal(size=(n, 4))
    x[rng.random((n, 4)) < 0.1] = np.nan
    x[:, 2] = 5.0
    fold = np.arange(n) % 3
    x[fold == 1, 3] = 1.0  # outside fold 0 and 2 it varies; in training without 1 too, in 1's complement as well
    x[fold != 1, 3] = 2.0  # constant outside fold 1
    y = np.nan_to_num(x[:, 0]) * 2 - np.nan_to_num(x[:, 1]) + rng.normal(size=n) / 5
    rows = [(i, int(fold[i]), float(y[i]), *[None if np.isnan(v) else float(v) for v in x[i]]) for i in range(n)] + [(990, 0, None, 1.0, 1.0, 1.0, 1.0), (991, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, f int, y double, a double, b double, c double, d double").repartition(6)
    predictions, folds, dropped = validation.cross_validate(df, ["id"], ["a", "b", "c", "d"], "y", "f")
    got = {r["id"]: r["y_pred"] for r in predictions.collect()}
    gone = {(r["fold"], r["feature"]): r["verdict"] for r in dropped.collect()}
    assert gone == {(0, "c"): "constant", (1, "c"): "constant", (2, "c"): "constant", (1, "d"): "constant"} and set(got) == set(range(n))
    told = {r["fold"]: r for r in folds.collect()}
    for f in range(3):
        keep = [0, 1] if f == 1 else [0, 1, 3]
        train, test = fold != f, fold == f
        mid = np.nanmedian(x[train], axis=0)
        z = np.where(np.isnan(x), mid, x)[:, keep]
        mean, sd = z[train].mean(0), z[train].std(0)
        a = (z - mean) / np.where(sd > 1e-12, sd, 1)
        beta = np.linalg.solve(a[train].T @ a[train] + np.eye(len(keep)), a[train].T @ (y[train] - y[train].mean()))
        pred = a[test] @ beta + y[train].mean()
        assert np.allclose([got[i] for i in np.flatnonzero(test)], pred)
        assert (told[f]["n_train"], told[f]["n_test"], told[f]["n_features_used"], told[f]["n_features_dropped"]) == (60, 30, len(keep), 4 - len(keep))
        assert math.isclose(told[f]["rmse"], np.sqrt(((pred - y[test]) ** 2).mean())) and math.isclose(told[f]["spearman"], np.corrcoef(ranks(pred), ranks(y[test]))[0, 1])
    summary = validation.cv_summary(folds.withColumn("config", F.lit("A")), ["config"]).first()
    assert summary["n_folds"] == 3 and summary["n_samples"] == n and math.isclose(summary["mae_mean"], np.mean([r["mae"] for r in told.values()]))
    plain = validation.cross_validate(df, ["id"], ["c"], "y", "f")[0].where("fold = 0").first()
    assert math.isclose(plain["y_pred"], y[fold != 0].mean())
    assert validation.cross_validate(df.where("f = 0"), ["id"], ["a"], "y", "f")[0].count() == 0
