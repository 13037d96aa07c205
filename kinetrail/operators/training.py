"""Small networks trained synchronously over partitions, many jobs side by side; no task holds a job's rows.

Every step is one pass over its mini-batch: tasks add up gradients for all jobs that their rows belong to, blocks of
partial sums are added up by a tree, and the driver moves the parameters (AdamW) and broadcasts them again. What moves
per step is a gradient a job and task, never a row. The networks are those of :func:`models.train_mlp`: two hidden layers
(linear, ReLU, layer norm) and a linear head on standardised data; with one batch an epoch a step equals that of plain
full-batch training.

A job is a number; a row says in an array which jobs it trains (``train``) and which it tests (``test``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.sources.store import scratch

#: Rows of a mini-batch; an epoch has at most ``MOST_STEPS`` of them, beyond which they grow.
BATCH, MOST_STEPS = 8192, 8
FAN_IN = 16
#: Rows whose hidden layers a gradient holds at a time, so that they stay in a processor's cache.
CHUNK = 256


def job_numbers(jobs: list[dict], belongs: Callable[[Column], Column]) -> Column:
    """The numbers of those jobs that a row belongs to; ``belongs`` gets a job's fields as a struct."""
    if not jobs:
        return F.array().cast("array<int>")
    told = F.array(*[F.struct(F.lit(i).alias("job"), *[F.lit(v).alias(k) for k, v in job.items()]) for i, job in enumerate(jobs)])
    return F.transform(F.filter(told, belongs), lambda j: j["job"])


class Network:
    """The shape of a network, its parameters as one flat vector, and gradients of summed squared errors."""

    def __init__(self, n_in: int, n_out: int, hidden: int = 128):
        sizes = [n_in, hidden, hidden, n_out]
        self.shapes = [*zip(sizes, sizes[1:]), *[(o,) for o in sizes[1:]], *[(hidden,)] * 4]
        self.edges = np.cumsum([0, *[int(np.prod(s)) for s in self.shapes]])
        self.n_in, self.n_out, self.hidden = n_in, n_out, hidden

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        w = [rng.uniform(-1, 1, s) / np.sqrt(s[0]) for s in self.shapes[:3]]
        h = self.hidden
        return np.concatenate([*[x.ravel() for x in w], np.zeros(2 * h + self.n_out), np.ones(2 * h), np.zeros(2 * h)])

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        return [flat[a:b].reshape(s) for a, b, s in zip(self.edges, self.edges[1:], self.shapes)]

    def forward(self, params: list[np.ndarray], z: np.ndarray):
        kept = []
        for i in range(2):
            r = np.maximum(z @ params[i] + params[3 + i], 0)
            inv = 1 / np.sqrt(r.var(1, keepdims=True) + 1e-5)
            h = (r - r.mean(1, keepdims=True)) * inv
            kept.append((z, r, h, inv))
            z = h * params[6 + i] + params[8 + i]
        return z @ params[2] + params[5], z, kept

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray, kind: type = np.float64, weight: np.ndarray | None = None) -> np.ndarray:
        """Summed over all rows, each taken ``weight`` times; worked out in numbers of ``kind``, ``CHUNK`` rows at a time, added up as doubles.

        What a layer norm scales, shifts and centres is folded into the weights that follow it, so a chunk only meets the
        norm itself; a unit's values lie side by side and are changed in place.
        """
        w1, w2, w3, b1, b2, b3, scale1, scale2, shift1, shift2 = self.parts(flat)
        folded = [w1, scale1[:, None] * w2, scale2[:, None] * w3]
        folded = [f.astype(kind) for f in (w1, folded[1] - folded[1].mean(0), folded[2] - folded[2].mean(0))]
        turned, bias = [np.ascontiguousarray(f.T) for f in folded], [b.astype(kind)[:, None] for b in (b1, b2 + shift1 @ w2, b3 + shift2 @ w3)]
        mean, per_weight, per_bias = np.full((1, self.hidden), 1 / self.hidden, kind), [np.zeros(f.shape) for f in turned], [np.zeros(len(b)) for b in bias]
        x, y, twice = x.T, y.T, np.full(len(x), 2.0) if weight is None else 2.0 * weight
        n = 0
        for at in range(0, len(twice), CHUNK):
            z, target, kept = x[:, at : at + CHUNK].astype(kind, order="C"), y[:, at : at + CHUNK].astype(kind, order="C"), []
            if z.shape[1] != n:
                n = z.shape[1]
                ones, (first, second, one, other), on = np.ones(n, kind), np.empty((4, self.hidden, n), kind), np.empty((2, self.hidden, n), bool)
            for i, r in enumerate((first, second)):
                np.matmul(turned[i], z, out=r)
                r += bias[i]
                r *= np.greater(r, 0, out=on[i])
                r -= mean @ r
                inv = 1 / np.sqrt(mean @ np.multiply(r, r, out=one) + kind(1e-5))
                r *= inv
                kept.append((z, r, inv))
                z = r
            g = turned[2] @ z
            g += bias[2] - target
            g *= twice[at : at + CHUNK].astype(kind)
            per_weight[2] += g @ z.T
            per_bias[2] += g @ ones
            g = np.multiply(folded[2], g, out=one) if self.n_out == 1 else np.matmul(folded[2], g, out=one)
            for i, free in ((1, other), (0, one)):
                z, h, inv = kept[i]
                h *= mean @ np.multiply(g, h, out=free)
                g -= h
                g *= inv
                g *= on[i]
                per_weight[i] += g @ z.T
                per_bias[i] += g @ ones
                if i:
                    g = np.matmul(folded[1], g, out=other)
        per_weight = [p.T for p in per_weight]
        grads = [per_weight[0], scale1[:, None] * per_weight[1] + np.outer(shift1, per_bias[1]), scale2[:, None] * per_weight[2] + np.outer(shift2, per_bias[2]), *per_bias]
        grads += [(per_weight[1] * w2).sum(1), (per_weight[2] * w3).sum(1), w2 @ per_bias[1], w3 @ per_bias[2]]
        return np.concatenate([v.ravel() for v in grads])


def vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def masks(column: pa.Array, wanted: set[int]) -> dict[int, np.ndarray]:
    """Which rows of a batch name a job, for the jobs that any row names."""
    ends, jobs = column.offsets.to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), np.diff(ends))
    return {int(j): row[jobs == j] for j in np.unique(jobs) if int(j) in wanted}


def added(rows: DataFrame, parts: int, n_jobs: int, size: int, work: Callable[[pa.RecordBatch], dict[int, np.ndarray]]) -> np.ndarray:
    """jobs x size: what ``work`` returns for the batches, added up by task (``parts`` at most), then by a tree of at most FAN_IN partial sums a group."""

    def partial(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for job, value in work(batch).items():
                total[job] = total[job] + value if job in total else value
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"job": pa.array(list(total), pa.int32()), "part": pa.array([part] * len(total), pa.int32()), "sums": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        sums = np.sum([np.frombuffer(x, float) for x in table.column("sums").to_pylist()], 0)
        return table.slice(0, 1).select(["job", "part"]).append_column("sums", pa.array([sums.tobytes()], pa.binary()))

    kind = "job int, part int, sums binary"
    level = rows.mapInArrow(partial, kind)
    while parts > FAN_IN:
        level = level.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("job", "part").applyInArrow(merge, kind)
        parts = -(-parts // FAN_IN)
    out = np.zeros((n_jobs, size))
    found = level.toArrow()  # a vector for each job and one of at most FAN_IN groups
    for job, sums in zip(found.column("job").to_pylist(), found.column("sums")):
        out[job] += np.frombuffer(sums.as_buffer(), float)
    return out


class Trained:
    """Parameters and scalings of all jobs; jobs without training rows are not in ``known``."""

    def __init__(self, net: Network, params: np.ndarray, scales: np.ndarray, known: set[int]):
        self.net, self.params, self.scales, self.known = net, params, scales, known

    def predict(self, job: int, x: np.ndarray) -> np.ndarray:
        mx, sx, my, sy = np.split(self.scales[job], np.cumsum([self.net.n_in, self.net.n_in, self.net.n_out]))
        return self.net.forward(self.net.parts(self.params[job]), (x - mx) / sx)[0] * sy + my


def train_networks(samples: DataFrame, seeds: list[int], train: str = "train", id_col: str = "sample_id", hidden: int = 128, epochs: int = 35, rate: float = 1e-3, decay: float = 1e-5, batch: int = BATCH, most_steps: int = MOST_STEPS) -> Trained:
    """One network for each of ``seeds``: job i trains on the rows whose ``train`` array names i. Columns: x and y arrays.

    Rows are dealt to an epoch's steps by a hash of their id and stored by step, so a step reads its own rows only. Rows of
    a step that are equal in x, y and jobs are stored once with their number, which is exact: they count that often.
    Gradients of mini-batches are worked out in single precision (as such networks commonly are) and added up in double;
    parameters are doubles. With one batch an epoch all is in double precision.
    """
    n_jobs = len(seeds)
    rows = samples.where(F.size(train) > 0)
    n, n_in, n_out = rows.agg(F.count("*"), F.max(F.size("x")), F.max(F.size("y"))).first()
    if not n:
        return Trained(Network(1, 1, 1), np.zeros((n_jobs, 0)), np.zeros((n_jobs, 0)), set())
    steps = max(1, min(most_steps, -(-n // batch)))
    precision = np.float64 if steps == 1 else np.float32
    stored = rows.select(*[F.col(c).cast("array<double>").alias(c) for c in ("x", "y")], F.col(train).cast("array<int>").alias(train), F.pmod(F.xxhash64(F.col(id_col)), F.lit(steps)).cast("int").alias("step"))
    stored = stored.groupBy("x", "y", train, "step").agg(F.count("*").alias("weight"))
    # as many files a step as there are cores: every step is a pass of all of them
    stored = scratch(stored.repartition(samples.sparkSession.sparkContext.defaultParallelism), "training-rows", ["step"])
    of_step = [stored.where(F.col("step") == s).drop("step") for s in range(steps)]
    parts = [rows.rdd.getNumPartitions() for rows in (stored, *of_step)]
    wanted = set(range(n_jobs))

    def moments(about: np.ndarray, power: int):
        def work(b: pa.RecordBatch) -> dict[int, np.ndarray]:
            both, times = np.hstack([vectors(b.column(0), n_in), vectors(b.column(1), n_out)]), b.column(3).to_numpy()
            return {j: np.append(times[at] @ (both[at] - about[j]) ** power, times[at].sum()) for j, at in masks(b.column(2), wanted).items()}

        return added(stored.drop("step"), parts[0], n_jobs, n_in + n_out + 1, work)

    first = moments(np.zeros((n_jobs, n_in + n_out)), 1)
    counts = np.maximum(first[:, -1:], 1)
    mean = first[:, :-1] / counts
    spread = np.sqrt(moments(mean, 2)[:, :-1] / counts)
    spread[spread < 1e-8] = 1.0
    scales = np.hstack([mean[:, :n_in], spread[:, :n_in], mean[:, n_in:], spread[:, n_in:]])
    known = set(np.flatnonzero(first[:, -1] > 0).tolist())

    net = Network(n_in, n_out, hidden)
    params = np.stack([net.start(s) for s in seeds])
    m, v, t = np.zeros_like(params), np.zeros_like(params), 0
    context = samples.sparkSession.sparkContext
    for _ in range(epochs):
        for step in range(steps):
            now = context.broadcast((params, scales))

            def work(b: pa.RecordBatch, now=now) -> dict[int, np.ndarray]:
                flat, scale = now.value
                x, y, times, out = vectors(b.column(0), n_in), vectors(b.column(1), n_out), b.column(3).to_numpy(), {}
                for j, at in masks(b.column(2), wanted).items():
                    mx, sx, my, sy = np.split(scale[j], np.cumsum([n_in, n_in, n_out]))
                    out[j] = np.append(net.gradient(flat[j], (x[at] - mx) / sx, (y[at] - my) / sy, precision, times[at]), times[at].sum())
                return out

            sums = added(of_step[step], parts[1 + step], n_jobs, params.shape[1] + 1, work)
            now.unpersist()
            here = sums[:, -1] > 0
            g = sums[:, :-1] / np.maximum(sums[:, -1:] * n_out, 1)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = params * (1 - rate * decay) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            params = np.where(here[:, None], move, params)
    return Trained(net, params, scales, known)


def window_errors(samples: DataFrame, trained: Trained, scale: list[float], test: str = "test", keep: list[str] | None = None) -> DataFrame:
    """(keep, job, mse, mae, normalized_mse) of every row and trained job that its ``test`` array names."""
    keep = keep or []
    rows = samples.where(F.size(test) > 0).select(F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"), F.col(test).cast("array<int>").alias(test), *keep)
    sent, sd = samples.sparkSession.sparkContext.broadcast(trained), np.array(scale, float)

    def run(batches: Iterator[pa.RecordBatch]):
        model = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x, y = vectors(b.column(0), model.net.n_in), vectors(b.column(1), model.net.n_out)
            for j, at in masks(b.column(2), model.known).items():
                err = model.predict(j, x[at]) - y[at]
                figures = [(err**2).mean(1), np.abs(err).mean(1), ((err / sd) ** 2).mean(1)]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(at)) for c in b.columns[3:]], pa.array(np.full(len(at), j), pa.int32()), *[pa.array(f) for f in figures]], [*keep, "job", "mse", "mae", "normalized_mse"])

    kinds = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep], "job int", "mse double", "mae double", "normalized_mse double"])
    return rows.mapInArrow(run, kinds)


def target_scale(rows: DataFrame, y: str = "y") -> list[float]:
    """The targets' deviations (ddof 0) over all rows; 1 for a constant one."""
    per = rows.select(F.posexplode(F.col(y).cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.stddev_pop("v").alias("s")).collect()  # one row a target
    return [r["s"] if r["s"] and r["s"] > 1e-8 else 1.0 for r in sorted(per, key=lambda r: r["i"])]


def imitation(errors: DataFrame, by: list[str]) -> DataFrame:
    """Errors of windows -> by ``by``: n, mean mse, mae and normalized_mse, and imitation_score = exp(-normalised error)."""
    found = errors.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("mse", "mae", "normalized_mse")])
    return found.withColumn("imitation_score", F.exp(-F.col("normalized_mse")))
