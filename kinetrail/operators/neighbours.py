"""Exact nearest neighbours of vectors by a pivot index: most pairs are ruled out by the triangle inequality.

Every row belongs to the cell of its nearest pivot. Rows are compared within their cell first; the distance found bounds
the search, and a row then only visits cells whose ball it could reach, and within them only members whose distance to
the cell's pivot is near its own. What is ruled out can't be nearer, so the result is that of comparing all pairs.

Pivots are rows picked by a hash, about the square root of the number of rows, at most ``MOST_PIVOTS`` and ``MOST_CELLS``
numbers in all. Members and visitors of a large cell are dealt out in tiles, so a task holds two tiles at a time.

The index moves a row once for each cell it visits. Where it rules out too little for that to pay (many independent
elements, or one dense cell), all pairs of blocks are compared instead, by matrix products: a row then moves once for
each block, about n x width / ``BLOCK_NUMBERS`` times. Equal vectors are one row of the search throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.operators.scoring import beside
from kinetrail.sources.store import scratch

MOST_PIVOTS, MOST_CELLS = 4096, 4_000_000
TILE = 2000
#: Rows of a table that is one tile.
SMALL = 4096
#: Numbers in a block of vectors, and the least blocks that a table is cut into.
BLOCK_NUMBERS, LEAST_BLOCKS = 2_000_000, 12


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances between two tiles, some rows at a time."""
    out = np.empty((len(x), len(y)))
    step = max(1, 2_000_000 // max(1, y.size))
    for i in range(0, len(x), step):
        out[i : i + step] = np.sqrt(((x[i : i + step, None, :] - y[None, :, :]) ** 2).sum(2))
    return out


def _lower(best: np.ndarray, at: np.ndarray, x: np.ndarray, other: np.ndarray, y: np.ndarray) -> None:
    """Lowers ``best`` at rows ``at`` of x to their distances from rows ``other`` of y."""
    for i in range(0, len(at), 50_000):
        p, q = at[i : i + 50_000], other[i : i + 50_000]
        np.minimum.at(best, p, np.sqrt(((x[p] - y[q]) ** 2).sum(1)))


def nearest_between(x: np.ndarray, y: np.ndarray, best_x: np.ndarray, best_y: np.ndarray, same: bool = False) -> None:
    """Lowers ``best_x`` and ``best_y`` to the distances between two blocks; ``same``: x is y, a row isn't its own neighbour.

    Half the squared distances come as a matrix product; its rounding error is bounded, and all pairs that it can't tell
    from the smallest are measured exactly.
    """
    xx, yy = (x * x).sum(1) / 2, (y * y).sum(1) / 2
    slack = 4 * np.finfo(float).eps * (x.shape[1] + 8) * (xx.max() + yy.max())
    left, right = np.column_stack([-x, np.ones(len(x)), xx]), np.column_stack([y, yy, np.ones(len(y))])
    step = max(1, 1_000_000 // len(y))
    for i in range(0, len(x), step):
        half = left[i : i + step] @ right.T
        if same:
            half[np.arange(len(half)), np.arange(i, i + len(half))] = np.inf
        for axis, best, first in ((1, best_x, i), (0, best_y, 0)):
            least = half.min(axis)
            part = best[first : first + len(least)]
            hot = np.flatnonzero(least <= part * part / 2 + slack)
            if len(hot):
                mine = half[hot] if axis else half[:, hot].T
                p, q = np.nonzero(mine <= least[hot, None] + 2 * slack)
                keep = np.isfinite(mine[p, q])
                p, q = hot[p[keep]] + first, q[keep] + (0 if axis else i)
                _lower(best, p, x if axis else y, q, y if axis else x)


def standardised(df: DataFrame, vector: str, into: str = "x") -> DataFrame:
    """The vector's z-scores (ddof 1; a constant element is only centred); elements' figures are one row."""
    long = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("i", "v"))
    per = long.groupBy("i").agg(F.avg("v").alias("a"), F.stddev_samp("v").alias("s"))
    figures = per.agg(F.sort_array(F.collect_list(F.struct("i", "a", F.when(F.col("s") > 1e-12, F.col("s")).otherwise(F.lit(1.0)).alias("s")))).alias("_f"))
    z = F.zip_with(F.col(vector).cast("array<double>"), "_f", lambda v, f: (v - f["a"]) / f["s"])
    return beside(df, figures).withColumn(into, z).drop("_f")


def nearest(df: DataFrame, id_col: str, vector: str, tile: int = TILE, pivots: int | None = None, small: int = SMALL) -> DataFrame:
    """(id, distance, compared): every row's distance to its nearest other row, NULL if there is none; how many it was compared with.

    Vectors are of one width and without NULLs. Rows that share an id are others to each other; so are rows with a NULL
    id. ``compared`` counts distances computed for the row, those to pivots included; of equal vectors one is compared. A table of at most ``small`` rows is
    one tile: all its pairs are compared, in one task.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = scratch(df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("x"), F.monotonically_increasing_id().alias("row")), "vectors")
    n, width = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        return df.sparkSession.createDataFrame([], f"id {kind}, distance double, compared long")
    width = max(1, width)
    if n <= small:

        def whole(batches: Iterator[pa.RecordBatch]):
            held = [b for b in batches if b.num_rows]
            if held:
                table = pa.Table.from_batches(held)
                x = _matrix(table.column("x"), width)
                best = np.full(len(x), np.inf)
                for i in range(0, len(x), 256):
                    d = _distances(x[i : i + 256], x)
                    d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
                    best[i : i + 256] = d.min(1)
                found = pa.array(best, mask=np.isinf(best))
                yield pa.RecordBatch.from_arrays([table.column("id").combine_chunks(), found, pa.array(np.full(len(x), len(x) - 1), pa.int64())], ["id", "distance", "compared"])

        return rows.coalesce(1).mapInArrow(whole, f"id {kind}, distance double, compared long")
    every = rows
    rows = scratch(every.groupBy("x").agg(F.min_by("id", "row").alias("id"), F.min("row").alias("row"), F.count("*").alias("copies")).select("id", "x", "row", "copies"), "vectors-distinct")
    copies, n = rows.select("row", "copies"), rows.count()
    rows = rows.drop("copies")
    k = pivots or max(1, min(MOST_PIVOTS, MOST_CELLS // width, math.isqrt(n)))
    block = max(1, min(BLOCK_NUMBERS // width, -(-n // LEAST_BLOCKS)))
    blocks = -(-n // block)
    picked = rows.orderBy(F.xxhash64("row"), "row").limit(k).collect()  # the index's pivots
    centres, own = np.array([r["x"] for r in picked], float).reshape(-1, width), np.array([r["row"] for r in picked])

    def place(batches: Iterator[pa.RecordBatch]):
        """Own cell, distance to its pivot, and the distance to the nearest pivot that is another row."""
        for batch in batches:
            x, row = _matrix(batch.column(1), width), batch.column(2).to_numpy()
            d = _distances(x, centres)
            cell = d.argmin(1)
            at = d[np.arange(len(x)), cell] if len(x) else np.zeros(0)
            d[row[:, None] == own[None, :]] = np.inf
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(at), pa.array(d.min(1, initial=np.inf))], ["id", "x", "row", "cell", "at", "bound"])

    placed = scratch(rows.mapInArrow(place, f"id {kind}, x array<double>, row long, cell int, at double, bound double"), "vectors-placed")
    sizes = placed.groupBy("cell").agg(F.max("at").alias("radius"), F.min("at").alias("least"), F.ceil(F.count("*") / tile).cast("int").alias("tiles"), F.count("*").alias("rows"))
    cells = {r["cell"]: (r["radius"], r["least"], r["tiles"]) for r in sizes.collect()}  # at most one row a pivot
    radius, least = (np.array([cells.get(i, (-np.inf, np.inf, 0))[j] for i in range(k)], float) for j in (0, 1))
    tiles = F.element_at(F.array(*[F.lit(int(cells.get(i, (0, 0, 0))[2])) for i in range(k)]), F.col("cell") + 1)
    placed = placed.withColumns({"tiles": tiles, "tile": F.pmod(F.xxhash64("row"), F.greatest(tiles, F.lit(1))).cast("int")})

    def compare(members: pa.Table, visitors: pa.Table) -> pa.Table:
        row, best, compared = visitors.column("row").to_numpy(), visitors.column("bound").to_numpy().copy(), np.zeros(visitors.num_rows, np.int64)
        if members.num_rows and visitors.num_rows:
            order = np.argsort(members.column("at").to_numpy(), kind="stable")
            at, names, y = members.column("at").to_numpy()[order], members.column("row").to_numpy()[order], _matrix(members.column("x"), width)[order]
            x, there = _matrix(visitors.column("x"), width), visitors.column("at").to_numpy()
            for i in range(len(row)):
                near = int(np.searchsorted(at, there[i]))
                spans = [(near - 64, near + 64), (0, near - 64), (near + 64, len(at))]  # members about as far from the pivot first
                for p, q in spans:
                    p, q = max(p, int(np.searchsorted(at, there[i] - best[i], "right"))), min(q, int(np.searchsorted(at, there[i] + best[i], "left")))
                    if p < q:
                        d = np.sqrt(((y[p:q] - x[i]) ** 2).sum(1))
                        d[names[p:q] == row[i]] = np.inf
                        compared[i] += q - p
                        best[i] = min(best[i], d.min())
        return pa.table({"row": row, "bound": best, "compared": compared})

    def visit(guests: DataFrame) -> DataFrame:
        """(row, bound, compared) of guests (row, x, cell, at, bound) that meet all members of a cell.

        The guests of a cell are cut to slices of about ``tile`` by a hash; each slice meets each tile of members.
        """
        guests = guests.select(*[F.col(c).alias(c) for c in guests.columns])  # columns of their own, should they be the hosts'
        slices = guests.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("slices"))
        hosts = placed.select("cell", "tile", "row", "x", "at").join(slices, "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        guests = guests.join(slices, "cell").withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int"))
        guests = guests.withColumn("tile", F.explode(F.sequence(F.lit(0), F.greatest(tiles, F.lit(1)) - 1)))
        key = ["cell", "tile", "slice"]
        return hosts.select(*key, "row", "x", "at").groupBy(*key).cogroup(guests.select(*key, "row", "x", "at", "bound").groupBy(*key)).applyInArrow(compare, "row long, bound double, compared long")

    def pairs() -> DataFrame:
        """(row, bound, compared): every block met every other and itself."""
        mine = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
        dealt = placed.select("row", "x", "bound", mine.alias("block")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        dealt = dealt.select("row", "x", "bound", "block", F.least("block", "_j").alias("lo"), F.greatest("block", "_j").alias("hi"))

        def meet(table: pa.Table) -> pa.Table:
            own, lo, hi = (table.column(c).to_numpy() for c in ("block", "lo", "hi"))
            x, row, best = _matrix(table.column("x"), width), table.column("row").to_numpy(), table.column("bound").to_numpy().copy()
            a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            compared = np.where(own == lo, len(b), len(a))
            if len(a) and len(b):
                best_a, best_b = best[a], best[b]
                nearest_between(x[a], x[b], best_a, best_b, bool(lo[0] == hi[0]))
                best[a] = np.minimum(best[a], best_a)
                best[b] = np.minimum(best[b], best_b)
            return pa.table({"row": row, "bound": best, "compared": compared})

        met = dealt.repartition(min(2000, blocks * (blocks + 1) // 2), "lo", "hi").groupBy("lo", "hi").applyInArrow(meet, "row long, bound double, compared long")
        return met.groupBy("row").agg(F.min("bound").alias("bound"), F.sum("compared").alias("compared"))

    def result(best: DataFrame) -> DataFrame:
        """(id, distance, compared) of every row: a vector that is there twice is at distance 0."""
        best = best.groupBy("row").agg(F.min("bound").alias("bound"), (F.sum("compared") + k).alias("compared")).join(copies, "row")
        found = every.select("id", "row").join(best, "row", "left")
        distance = F.when(F.coalesce(F.col("copies"), F.lit(2)) > 1, F.lit(0.0)).when(F.col("bound") < float("inf"), F.col("bound"))
        return found.select("id", distance.alias("distance"), F.coalesce("compared", F.lit(0).cast("long")).alias("compared"))

    # rows that a cell's tiles move, against those that all blocks move
    crowded = sizes.agg(F.sum(F.col("rows") * F.col("tiles"))).first()[0]
    if 2 * crowded > n * blocks:
        return result(pairs())
    first = visit(placed.select("row", "x", "cell", "at", "bound"))
    found = scratch(first.groupBy("row").agg(F.min("bound").alias("bound"), F.sum("compared").alias("compared")), "vectors-first")
    known = placed.select("id", "row", "x", F.col("cell").alias("home")).join(found, "row")

    def reached(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, all distances to pivots): the cells that a row could still find a nearer one in."""
        x, bound = _matrix(batch.column(1), width), batch.column(3).to_numpy()
        d = _distances(x, centres)
        reach = (d - radius[None, :] < bound[:, None]) & (least[None, :] - d < bound[:, None]) & (np.arange(k)[None, :] != batch.column(2).to_numpy()[:, None])
        return *np.nonzero(reach), d

    def visits(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            cell = reached(batch)[1]
            yield pa.RecordBatch.from_arrays([pa.array([int(tiles_of[cell].sum())], pa.int64())], ["n"])

    def others(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            bound = batch.column(3).to_numpy()
            i, c, d = reached(batch)
            for s in range(0, len(i), 10_000):
                p, q = i[s : s + 10_000], c[s : s + 10_000]
                take = pa.array(p)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(q, pa.int32()), pa.array(d[p, q]), pa.array(bound[p])], ["row", "x", "cell", "at", "bound"])

    known = known.select("row", "x", "home", "bound")
    tiles_of = np.array([cells.get(i, (0, 0, 0))[2] for i in range(k)], np.int64)
    # a guest is stored and moved: three times a block's row
    if 3 * (known.mapInArrow(visits, "n long").agg(F.sum("n")).first()[0] or 0) > n * blocks:
        return result(found.union(pairs()))
    guests = scratch(known.mapInArrow(others, "row long, x array<double>, cell int, at double, bound double"), "vectors-guests")
    return result(found.union(visit(guests)))


def uniqueness(df: DataFrame, id_col: str, vector: str, tile: int = TILE) -> DataFrame:
    """(id, uniqueness): distance to the nearest other row, of z-scored vectors, over the largest such distance; 0 where that is nil."""
    near = scratch(nearest(standardised(df, vector), id_col, "x", tile), "nearest")
    top = near.agg(F.max("distance").alias("top"))
    unique = F.when(F.coalesce(F.col("top"), F.lit(0.0)) <= 1e-12, F.lit(0.0)).otherwise(F.coalesce("distance", F.lit(0.0)) / F.nullif(F.col("top"), F.lit(0.0)))
    return beside(near, top).select(F.col("id").alias(id_col), unique.alias("uniqueness"))
