"""One-to-one matching on a score, and bootstrap intervals, without a task that holds a group.

Matching takes the closest free pair again and again (within a scene, up to a caliper). Done in rounds: in the order of
scores, a treated and a control unit that are each other's nearest free unit of the other arm are neighbours in that
order, and all such pairs can be matched at once, since no later pair could have been closer for either. Units of one
arm and one score are one *atom* with a count, so ties cost one row. Orders are cut to slices; what a slice needs to know
about its neighbours is carried over its borders, one row a slice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.functions.columns import logit
from kinetrail.operators.order import running
from kinetrail.sources.store import scratch

#: Places of an atom that meet the pairs of atoms together when units get their partners.
CHUNK = 1024
#: Atoms in all that are matched without slices, in a task a scene.
MOST_ATOMS = 100_000
#: Rows that get their bootstrap weights at a time, and groups whose sums a task holds before it hands them on.
DRAWN, MOST_GROUPS = 2000, 1000


def sliced(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``df`` stored in order, with the slice (``_slice``) that a row lies in; a large group spans many slices."""
    return scratch(df.repartitionByRange(*[F.col(c) for c in [*by, *order]]).withColumn("_slice", F.spark_partition_id()), "sliced")


def last_before(rows: DataFrame, by: list[str], order: list[str], value: Column, into: str, ahead: bool = False) -> DataFrame:
    """``into``: the last value that isn't NULL in rows before this one (``ahead``: the first one behind it), across slices.

    ``rows`` come from :func:`sliced`; (by, order) tells rows apart.
    """
    turn = F.desc if ahead else F.asc
    place = F.struct(*[F.col(c) for c in order])
    within = W.partitionBy(*by, "_slice").orderBy(*[turn(c) for c in order])
    edge = (F.min_by if ahead else F.max_by)(value, F.when(value.isNotNull(), place))
    ends = rows.groupBy(*by, "_slice").agg(edge.alias("_edge"))
    carry = F.last("_edge", True).over(W.partitionBy(*by).orderBy(turn("_slice")).rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(*by, "_slice", carry.alias("_carry"))
    found = rows.withColumn("_own", F.last(value, True).over(within.rowsBetween(W.unboundedPreceding, -1)))
    return found.join(ends, [*by, "_slice"]).withColumn(into, F.coalesce("_own", "_carry")).drop("_own", "_carry")


def _rounds(table: pa.Table) -> pa.Table:
    """:func:`closest_pairs`' rounds on one scene's atoms in arrays."""
    order = np.argsort(table.column("z").to_numpy(), kind="stable")
    z, t, used, n, caliper = (table.column(c).to_numpy()[order] for c in ("z", "t", "used", "n", "caliper"))
    used, n, out = used.copy(), n.copy(), []
    while len(z):
        at, size = np.arange(len(z)), len(z)
        below, above = np.full(size, -1), np.full(size, size)
        for arm in (0, 1):
            mine, other = t == arm, t != arm
            below[mine] = np.maximum.accumulate(np.where(other, at, -1))[mine]
            above[mine] = np.minimum.accumulate(np.where(other, at, size)[::-1])[::-1][mine]
        down = np.where(below >= 0, z - z[np.maximum(below, 0)], np.inf)
        up = np.where(above < size, z[np.minimum(above, size - 1)] - z, np.inf)
        to, distance = np.where(down <= up, below, above), np.minimum(down, up)
        near = distance <= caliper
        to = np.where(near, to, -1)
        i = np.flatnonzero((t == 1) & near)
        i = i[to[to[i]] == i]
        j = to[i]
        m = np.minimum(n[i], n[j])
        out.append([z[i], used[i], z[j], used[j], m, distance[i]])
        for k in (i, j):
            used[k] += m
            n[k] -= m
        keep = near & (n > 0)
        z, t, used, n, caliper = z[keep], t[keep], used[keep], n[keep], caliper[keep]
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 6
    scene = table.column("scene").combine_chunks().take(pa.array(np.zeros(len(columns[0]), np.int64)))
    kinds = [pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
    return pa.table([scene, *[pa.array(c).cast(k) for c, k in zip(columns, kinds)]], ["scene", "zt", "ot", "zc", "oc", "m", "distance"])


def closest_pairs(df: DataFrame, scene: str, id_col: str, treated: str, p: str = "p", caliper_ratio: float = 0.2, most_rounds: int = 1000, cell: str | None = None) -> DataFrame:
    """(scene, treated_id, control_id, distance): one-to-one pairs without replacement, closest pairs first, within scenes.

    The caliper is ``caliper_ratio`` standard deviations (ddof 1) of all logits. With ``cell``, a column without NULLs,
    every cell is matched on its own, with a caliper of its own, and its value leads the result's columns; all cells
    share the rounds. Of units that tie in score the smaller
    ids go first; of two partners at one distance the one of lower score. A NULL score or arm takes no part; NULL scenes
    are a scene. Unlike serving treated units one after another, no unit is given a partner that another one was closer
    to. Each round settles every pair of mutually nearest atoms; units without a partner in reach leave.
    """
    own = F.col(cell) if cell else F.lit(0)
    units = df.select(F.struct(own.alias("cell"), F.col(scene).alias("scene")).alias("scene"), F.col(id_col).alias("id"), F.col(treated).cast("int").alias("t"), logit(p).alias("z"))
    units = units.where("z is not null and t in (0, 1)")  # the struct of cell and scene is never NULL, whatever the scene
    caliper = units.groupBy(F.col("scene.cell").alias("cell")).agg((F.stddev_samp("z") * caliper_ratio).alias("caliper"))
    with_caliper = lambda rows: rows.withColumn("cell", F.col("scene.cell")).join(caliper, "cell").drop("cell")
    placed = scratch(running(units, ["scene", "z", "t"], [F.col("id")]).withColumn("_place", F.col("_place") - 1), "units-placed")
    atoms = placed.groupBy("scene", "z", "t").agg(F.count("*").alias("n"))
    # both arms at one score: pairs at distance 0
    wide = atoms.groupBy("scene", "z").agg(*[F.coalesce(F.sum(F.when(F.col("t") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in (0, 1)])
    wide = scratch(wide.withColumn("m", F.least("n0", "n1")), "atoms-wide")
    zero = F.lit(0).cast("long")
    pairs = [wide.where("m > 0").select("scene", F.col("z").alias("zt"), zero.alias("ot"), F.col("z").alias("zc"), zero.alias("oc"), "m", F.lit(0.0).alias("distance"))]
    left = wide.where("n0 <> n1").select("scene", "z", F.when(F.col("n1") > F.col("n0"), 1).otherwise(0).alias("t"), F.col("m").alias("used"), (F.greatest("n0", "n1") - F.col("m")).alias("n"))
    left = with_caliper(left)
    few = wide.limit(MOST_ATOMS + 1).count() <= MOST_ATOMS
    if few:  # a bounded number of rows in all: the same rounds, in one task a scene
        pairs.append(left.groupBy("scene").applyInArrow(_rounds, pairs[0].schema))
    for _ in range(0 if few else most_rounds):
        rows = sliced(left, ["scene"], ["z"])  # an atom's score is its own within a scene: one arm is left at each
        atom = F.struct("z", "t", "used", "n")
        other = {i: F.when(F.col("t") != i, atom) for i in (0, 1)}  # what arm i looks for
        for i in (0, 1):
            rows = last_before(rows, ["scene"], ["z"], other[i], f"_b{i}")
            rows = last_before(rows, ["scene"], ["z"], other[i], f"_a{i}", ahead=True)
        below, above = (F.when(F.col("t") == 0, F.col(f"_{s}0")).otherwise(F.col(f"_{s}1")) for s in "ba")
        rows = rows.select("scene", "z", "t", "used", "n", "caliper", below.alias("b"), above.alias("a"))
        db, da = F.col("z") - F.col("b.z"), F.col("a.z") - F.col("z")
        pick = F.when(F.col("a.z").isNull() | (db <= da), F.col("b")).otherwise(F.col("a"))
        rows = rows.withColumn("to", pick).withColumn("distance", F.abs(F.col("z") - F.col("to.z")))
        rows = scratch(rows.where("to is not null and distance <= caliper").drop("a", "b"), "atoms-near")
        if not rows.limit(1).count():
            break
        back = rows.where("t = 0").select("scene", F.col("z").alias("_z"), F.col("to.z").alias("_to"))
        mutual = rows.where("t = 1").withColumn("_z", F.col("to.z")).join(back, ["scene", "_z"]).where("_to = z")
        m = F.least("n", "to.n")
        met = scratch(mutual.select("scene", F.col("z").alias("zt"), F.col("used").alias("ot"), F.col("to.z").alias("zc"), F.col("to.used").alias("oc"), m.alias("m"), "distance"), "atoms-met")
        pairs.append(met)
        spent = met.select("scene", F.col("zt").alias("z"), "m").union(met.select("scene", F.col("zc").alias("z"), "m")).withColumnRenamed("m", "_m")
        left = rows.join(spent, ["scene", "z"], "left").withColumn("_m", F.coalesce("_m", zero))
        left = scratch(left.where("n > _m").select("scene", "z", "t", (F.col("used") + F.col("_m")).alias("used"), (F.col("n") - F.col("_m")).alias("n"), "caliper"), "atoms-left")
    else:
        if not few:
            raise RuntimeError("matching didn't end; raise most_rounds")
    found = pairs[0]
    for met in pairs[1:]:
        found = found.union(met)
    found = with_caliper(found).where("distance <= caliper").drop("caliper").withColumn("pair", F.monotonically_increasing_id())
    found = scratch(found, "atom-pairs")

    def named(z: str, start: str, arm: int, name: str) -> DataFrame:
        """(pair, i, id): the units that a pair of atoms takes, by their places in the atom."""
        chunks = F.explode(F.sequence(F.floor(F.col(start) / CHUNK), F.floor((F.col(start) + F.col("m") - 1) / CHUNK)))
        spans = found.select("scene", F.col(z).alias("z"), "pair", F.col(start).alias("o"), "m", chunks.alias("chunk"))
        own = placed.where(F.col("t") == arm).select("scene", "z", "id", "_place", F.floor(F.col("_place") / CHUNK).alias("chunk"))
        hit = own.join(spans, ["scene", "z", "chunk"]).where((F.col("_place") >= F.col("o")) & (F.col("_place") < F.col("o") + F.col("m")))
        return hit.select("pair", (F.col("_place") - F.col("o")).alias("i"), F.col("id").alias(name), *[F.col(f"scene.{c}").alias(c) for c in ("cell", "scene")])

    both = named("zt", "ot", 1, "treated_id").join(named("zc", "oc", 0, "control_id").drop("scene", "cell"), ["pair", "i"])
    lead = [F.col("cell").alias(cell)] if cell else []
    return both.join(found.select("pair", "distance"), "pair").select(*lead, "scene", "treated_id", "control_id", "distance")


def poisson_bounds(most: int = 12) -> list[float]:
    """Poisson(1)'s distribution: a number in [0, 1) draws as many as there are bounds up to it (``most`` holds all but 1e-10)."""
    upto, total = [], 0.0
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        upto.append(total)
    return upto


def poisson_weights(ids: list[str | None], n_boot: int, seed: int) -> np.ndarray:
    """ids x ``n_boot``: Poisson(1) numbers from MD5 of seed, replicate and id; one hash serves four replicates."""
    heads = [f"{seed}|{k}".encode() for k in range(-(-n_boot // 4))]
    tails = [b"" if i is None else b"|" + i.encode() for i in ids]
    hashes = b"".join([md5(head + tail).digest() for tail in tails for head in heads])
    u = np.frombuffer(hashes, ">u4").reshape(len(ids), -1)[:, :n_boot].astype(np.uint32)
    found = np.zeros(u.shape, np.uint8)
    for x in poisson_bounds():
        if (least := math.ceil(x * 2**32)) < 2**32:
            found += u >= np.uint32(least)
    return found


def bootstrap_effects(diffs: DataFrame, by: list[str], id_col: str = "treated_id", value: str = "diff", n_boot: int = 500, seed: int = 42) -> DataFrame:
    """(by, att, n_pairs, ci_low, ci_high): mean difference with a percentile interval over ``n_boot`` resamples.

    A resample gives every pair a Poisson(1) weight, which is drawn from a hash of seed, replicate and id: the limit of
    drawing with replacement, without an order or a group in one place. Rows of an id are dealt to one task, side by
    side, so that its weights are drawn once for all its groups; a task adds up its rows, and ``n_boot`` numbers a group
    and task move. NULL differences don't count; a resample of weight 0 has no mean.
    """
    rows = diffs.select(*by, F.col(id_col).cast("string").alias("_id"), F.col(value).cast("double").alias("_d")).where("_d is not null")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch(rows.repartition(tasks, "_id").sortWithinPartitions("_id"), "bootstrap-rows")

    def work(batches: Iterator[pa.RecordBatch]):
        total: dict[str, tuple[pa.RecordBatch, np.ndarray]] = {}

        def flush():
            for keys, sums in total.values():
                yield pa.RecordBatch.from_arrays([*keys.columns, *[pa.array([x.tolist()], pa.list_(pa.float64())) for x in sums]], [*by, "w", "s"])
            total.clear()

        for batch in (b.slice(i, DRAWN) for b in batches for i in range(0, b.num_rows, DRAWN)):
            named = batch.column(len(by)).dictionary_encode("encode")
            weights = poisson_weights(named.dictionary.to_pylist(), n_boot, seed).astype(float)
            at, d = named.indices.to_numpy(), batch.column(len(by) + 1).to_numpy()
            groups: dict[str, list[int]] = {}
            for i, row in enumerate(batch.select(by).to_pylist() if by else [None] * len(d)):
                groups.setdefault(repr(row), []).append(i)
            for key, mine in groups.items():
                sums = np.stack([np.ones(len(mine)), d[mine]]) @ weights[at[mine]]
                if key in total:
                    total[key][1][:] += sums
                else:
                    total[key] = batch.select(by).slice(mine[0], 1), sums
            if len(total) > MOST_GROUPS:
                yield from flush()
        yield from flush()

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*by).schema)
    draws = rows.mapInArrow(work, f"{kinds}w array<double>, s array<double>")
    draws = draws.select(*by, F.posexplode(F.arrays_zip("w", "s")).alias("_rep", "_x")).groupBy(*by, "_rep").agg(F.sum("_x.w").alias("w"), F.sum("_x.s").alias("s"))
    ends = draws.groupBy(*by).agg(F.percentile(F.when(F.col("w") > 0, F.col("s") / F.col("w")), F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    plain = rows.groupBy(*by).agg(F.avg("_d").alias("att"), F.count("*").alias("n_pairs"))
    same = None
    for c in by:
        cond = plain[c].eqNullSafe(ends[c])
        same = cond if same is None else same & cond
    joined = plain.crossJoin(ends) if same is None else plain.join(ends, same)
    return joined.select(*[plain[c] for c in by], "att", "n_pairs", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))
