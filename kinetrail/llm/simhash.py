"""SimHash near-dedup with pigeonhole blocks.

A fingerprint has one bit for each bit of its shingles' 64-bit hashes: 1 if over half the hashes have it. Two
fingerprints that differ in at most ``max_bits`` bits agree on all but ``max_bits`` of ``blocks`` blocks, so they
share the key of at least one choice of ``blocks - max_bits`` blocks. Fingerprints join on those keys and are then
verified by their Hamming distance.

Equal fingerprints are merged first (map-side combining), so a group of exact copies of any size is one row. Within a
key, verified links are reduced to a spanning star before they leave the task: a group of n near copies gives n - 1
links, never all pairs. Keys with over ``tile`` fingerprints are dealt out as pairs of tiles over many tasks, each
bounded by two tiles; no link is lost. The stars of all keys then go through connected components.

Defined results
* words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a text with fewer words than a shingle is one shingle; null,
  empty or blank texts have fingerprint zero and are linked like any other;
* repeated rows fall into one component; a null id never names a component unless all its ids are null;
* an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.llm.byte_bpe import blocks
from kinetrail.llm.common import fresh, quoted, stage, tidied
from kinetrail.llm.components import connected_components

SEED = 42
MAX_BITS = 3
BLOCKS = 6
TILE = 2048


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 of each n-word shingle, repeats included."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    whole = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    ends = (starts + sizes)[n - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts.tolist(), ends)), np.uint64, len(ends))


def fingerprint(text: str | None, n: int) -> int:
    """The fingerprint as a signed 64-bit integer."""
    hashes = shingle_hashes(text, n)
    ones = np.zeros(64, np.int64)
    for part in np.split(hashes, range(50_000, len(hashes), 50_000)):
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """Per row: doc_id, fp."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            fps = [fingerprint(t.as_py(), n) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _masks(max_bits: int, blocks: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = (sum(part[i] for i in chosen) for chosen in combinations(range(blocks), blocks - max_bits))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def star(group: np.ndarray, fps: np.ndarray, max_bits: int, names: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, root) that span each group's sets of linked fingerprints; ``group`` is sorted.

    Fingerprints of several words are rows of ``fps``; the links then hold their ``names``.
    """
    n = len(fps)
    label = np.arange(n)

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            while not np.array_equal(new, new[new]):
                new = new[new]
            if np.array_equal(new, label):
                return
            label = new

    at, step, held, size = np.arange(n), 1, [], 0
    while True:
        at = at[at + step < n]
        at = at[group[at] == group[at + step]]
        if not len(at):
            break
        apart = np.bitwise_count(fps[at] ^ fps[at + step])
        near = at[(apart if fps.ndim == 1 else apart.sum(1)) <= max_bits]
        if len(near):
            held.append((near, near + step))
            size += len(near)
        if size > 1_000_000:  # fold the links found so far into the labels
            settle(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            held, size = [], 0
        step += 1
    if held:
        settle(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
    moved = np.flatnonzero(label != np.arange(n))
    names = fps if names is None else names
    return names[moved], names[label[moved]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """(a, b): links between fingerprints (column fp, distinct) that span all pairs within ``max_bits`` bits."""
    masks = _masks(max_bits, blocks)
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    rows = distinct.select("fp", F.inline(keys))
    large = rows.groupBy("choice", "key").count().where(F.col("count") > tile).select("choice", "key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    rows = rows.join(large, ["choice", "key"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("choice", "key", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), "fp")
    dealt = rows.repartition("choice", "key", "t", "u").sortWithinPartitions("choice", "key", "t", "u", "fp")

    def run(batches: Iterator[pa.RecordBatch]):
        rest = None
        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(5)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            if not len(cols[0]):
                continue
            new = np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:4]])))
            last = int(np.flatnonzero(new)[-1])  # the last group may go on in the next batch
            rest = [c[last:] for c in cols]
            yield _found(np.cumsum(new)[:last], cols[4][:last])
        if rest is not None:
            yield _found(np.zeros(len(rest[0]), np.int64), rest[4])

    def _found(group: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = star(group, fps.astype(np.int64).view(np.uint64), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, max_bits: int = MAX_BITS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Per row: doc_id, fp, component_id (the smallest id reachable over links of at most ``max_bits`` bits)."""
    fps = stage(fingerprints(docs, id_col, text_col, n), "fingerprints")
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = connected_components(links(distinct.select("fp"), max_bits, blocks, tile))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


# --- Near-dedup by similarity -------------------------------------------------------------------------------------
#
# At a Jaccard similarity of 0.8, fingerprints of 64 bits differ in ten bits and more, too many for the pigeonhole on
# 64 bits. The same scheme then takes longer fingerprints: two texts of cosine c differ in a share arccos(c) / pi of
# the bits, so a block of b bits is equal with a known chance, and enough blocks make it near certain that some block
# is. b follows the logarithm of the number of rows, so chance meetings stay few at any size; the number of blocks
# follows from b and RECALL, which is therefore the same at any size.
#
# Fingerprints only find candidates. Those of a bucket that may be alike are joined to families, and within a family
# every pair is decided by the exact Jaccard similarity of the two sets of shingles, whatever the number of rows; a pair
# that verified links join already needs no decision. Hamming distances serve as screens, SCREEN standard deviations
# above what is expected at the wanted similarity.
#
# Large groups cost n, not n * n, as long as they hang together. A large bucket's rows are screened against a few
# leaders, and only rows near none of them meet all others. A large family is dealt out in tiles that share leaders;
# what these tiles link to one component needs no further decision, and only rows outside the largest component are
# then held against the tiles of all others.

SIMILARITY = 0.8
SHINGLE = 5
RECALL = 0.99
#: Words of 64 bits, apart from the blocks, that rows carry for a first check within a block's bucket.
CHECK_WORDS = 2
#: Standard deviations that a screen by Hamming distance allows; a pair at the wanted similarity passes all but surely.
SCREEN = 4
#: Rows of a bucket that are all compared with each other, and rows of a larger one that stand for it.
BUCKET_TILE = 512
BUCKET_LEADERS = 16
#: Texts and shingles in a tile of a family, and texts that all tiles of a family share.
FAMILY_TILE = 512
TILE_SHINGLES = 1 << 20
FAMILY_LEADERS = 32


def differing_share(similarity: float) -> float:
    """The expected share of differing bits at a Jaccard similarity (sets of like size)."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def plan(n_rows: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """(bits in a block, number of blocks). By chance about eight rows share a block's bucket, at any number of rows."""
    bits = max(12, int(np.ceil(np.log2(max(2, n_rows)))) - 3)
    same = (1 - differing_share(similarity)) ** bits
    return bits, int(np.ceil(np.log(1 - recall) / np.log(1 - same)))


def bits_allowed(size: int, similarity: float) -> int:
    """The screen: differing bits of ``size`` that a pair of this similarity stays under."""
    share = differing_share(similarity)
    return int(np.ceil(size * share + SCREEN * np.sqrt(size * share * (1 - share))))


def _ones(rows: np.ndarray) -> np.ndarray:
    """How many of ``rows`` (m x words) have each bit: words x 64. Full adders turn three rows into a sum and a carry."""
    total, weight = np.zeros(rows.shape[1] * 64, np.int32), 1
    while len(rows):
        carries = []
        while len(rows) > 2:
            k = len(rows) // 3
            a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
            odd = a ^ b
            carries.append(a & b | odd & c)
            rows = np.concatenate([odd ^ c, rows[3 * k :]])
        for row in rows:
            total += np.unpackbits(row.view(np.uint8), bitorder="little").astype(np.int32) * np.int32(weight)
        rows, weight = np.concatenate(carries) if carries else rows[:0], weight * 2
    return total.reshape(-1, 64)


def long_fingerprints(sets: list[np.ndarray], words: int) -> np.ndarray:
    """sets x words: fingerprints of ``words`` times 64 bits; each word takes other bits of each shingle's mixed hash."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros((len(sets), words), np.uint64)
    salts = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    most = max(1, 100_000 // words)  # hashes that are mixed at once
    order = np.argsort(sizes, kind="stable")[::-1]
    at = 0
    while at < len(order):  # sets of like size together; what a shorter one lacks counts as no bit
        longest = int(sizes[order[at]])
        some = order[at : at + max(1, most // max(1, longest))]
        at += len(some)
        ones = np.zeros((len(some) * words, 64), np.int64)
        for start in range(0, longest, most):
            size = min(most, longest - start)
            hashes, there = np.zeros((size, len(some)), np.uint64), np.zeros((size, len(some)), bool)
            for i, k in enumerate(some.tolist()):
                part = sets[k][start : start + size]
                hashes[: len(part), i] = part
                there[: len(part), i] = True
            mixed = hashes[:, :, None] ^ salts
            for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                mixed ^= mixed >> np.uint64(shift)
                mixed *= np.uint64(times)
            mixed ^= mixed >> np.uint64(31)
            mixed[~there] = 0
            ones += _ones(mixed.reshape(size, -1))
        over = ones.reshape(len(some), words, 64) * 2 > sizes[some][:, None, None]
        out[some] = np.packbits(over, axis=2, bitorder="little").view("<u8")[:, :, 0]
    return out


def alike(fps: np.ndarray, sets: list[np.ndarray], most: int, similarity: float, label: np.ndarray | None = None, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of links that span all pairs whose sets' Jaccard similarity is ``similarity`` or more.

    A pair is left undecided only if its labels or links found before join it, if its fingerprints differ in over
    ``most`` bits, or if both are on the same one of two sides.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(codes, np.cumsum(sizes)[:-1])
    mark = np.zeros(int(codes.max(initial=0)) + 1, bool)
    label = np.arange(len(sets)) if label is None else label.copy()
    out: list[tuple[int, int]] = []
    for a in range(len(sets) - 1):
        low, high = np.minimum(sizes[a + 1 :], sizes[a]), np.maximum(sizes[a + 1 :], sizes[a])
        open_ = (label[a + 1 :] != label[a]) & (low >= similarity * high - 1e-9)
        if side is not None:
            open_ &= side[a + 1 :] != side[a]
        others = a + 1 + np.flatnonzero(open_)
        others = others[np.bitwise_count(fps[others] ^ fps[a]).sum(1) <= most]
        if not len(others):
            continue
        mark[parts[a]] = True
        for b in others.tolist():
            if label[a] == label[b]:
                continue
            shared = np.count_nonzero(mark[parts[b]])
            if shared >= similarity * (sizes[a] + sizes[b] - shared) - 1e-9:
                out.append((a, b))
                label[label == label[b]] = label[a]
        mark[parts[a]] = False
    links = np.array(out, np.int64).reshape(-1, 2)
    return links[:, 0], links[:, 1]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups from batches sorted by their first ``keys`` columns: each table's rows hold complete groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy() for i in range(keys)]
        starts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in cols])) + 1
        if held and any(held[-1].column(i)[-1].as_py() != k[0] for i, k in enumerate(cols)):
            yield pa.Table.from_batches(held)
            held = []
        if len(starts):
            yield pa.Table.from_batches([*held, batch.slice(0, int(starts[-1]))])
            held = []
        held.append(batch.slice(int(starts[-1]) if len(starts) else 0))
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table, keys: int) -> np.ndarray:
    cols = [table.column(i).to_numpy() for i in range(keys)]
    return np.concatenate(([0], np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1))


def _bucket_links(dealt: DataFrame, most: int, tile: int) -> DataFrame:
    """(a, b): links that join every two ids of a bucket whose check words differ in at most ``most`` bits (and, in a
    large bucket, those that are near the same leaders)."""
    large = stage(dealt.groupBy("key").count().where(F.col("count") > tile).select("key"), "large-buckets")

    def link(batches: Iterator[pa.RecordBatch]):
        for table in _groups(batches, 1):
            group = np.zeros(table.num_rows, np.int64)
            group[_starts(table, 1)[1:]] = 1
            checks = np.stack([table.column(2 + i).to_numpy().view(np.uint64) for i in range(CHECK_WORDS)], 1)
            a, b = star(np.cumsum(group), checks, most, table.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    any_large = large.limit(1).count() > 0
    small = dealt.join(large, "key", "left_anti") if any_large else dealt
    found = small.repartition("key").sortWithinPartitions("key").mapInArrow(link, "a long, b long").where("a <> b")
    if not any_large:
        return found.distinct()
    row = F.struct("id", *[f"c{i}" for i in range(CHECK_WORDS)])
    rows = stage(dealt.join(large, "key").select("key", row.alias("r")), "large-bucket-rows")

    def near(x, y):
        return sum((F.bit_count(x[f"c{i}"].bitwiseXOR(y[f"c{i}"])) for i in range(CHECK_WORDS)), F.lit(0)) <= most

    place = F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64(F.lit("leader"), "r.id"), "r.id"))
    leaders = rows.select("key", "r", place.alias("p")).where(F.col("p") <= BUCKET_LEADERS).groupBy("key").agg(F.sort_array(F.collect_list("r")).alias("leaders"))
    led = rows.join(stage(leaders, "bucket-leaders"), "key").withColumn("led", F.exists("leaders", lambda x: near(x, F.col("r"))))
    led = stage(led.select("key", "r", F.when(F.col("led"), F.col("leaders")[0]["id"]).alias("to")), "led-rows")
    # rows near no leader meet all rows of their bucket, some hundred at a time
    stray = led.where("to is null").select("key", "r")
    tiles = stray.groupBy("key").agg(F.ceil(F.count("*") / 256).alias("tiles"))
    stray = stray.join(tiles, "key").groupBy("key", F.pmod(F.xxhash64("r.id"), F.col("tiles")).alias("t")).agg(F.collect_list("r").alias("strays"))
    met = rows.join(stage(stray, "strays"), "key").select("r", F.transform(F.filter("strays", lambda x: near(x, F.col("r"))), lambda x: x["id"]).alias("near")).where(F.size("near") > 0)
    met = met.select(F.explode(F.concat(F.array(F.struct(F.col("r.id").alias("a"), F.col("near")[0].alias("b"))), F.transform("near", lambda x: F.struct(F.col("near")[0].alias("a"), x.alias("b"))))).alias("l")).select("l.a", "l.b")
    own = led.where("to is not null").select(F.col("r.id").alias("a"), F.col("to").alias("b"))
    return found.union(own).union(met).where("a <> b").distinct()


class _Families:
    """Exact decisions within groups of rows. ``known``: id, n, fp, shingles; groups come as (key, id, ...)."""

    def __init__(self, known: DataFrame, words: int, similarity: float, tile: int):
        self.known, self.words, self.similarity, self.tile = known, words, similarity, tile
        self.bound = bits_allowed(64 * words, similarity)

    def tiles(self, rows: DataFrame, *by: str) -> DataFrame:
        """By group: rows and the number of tiles that hold them."""
        wanted = F.greatest(F.ceil(F.count("*") / self.tile), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
        return rows.groupBy(*by).agg(F.count("*").alias("rows"), wanted.alias("tiles"))

    def decide(self, dealt: DataFrame) -> DataFrame:
        """(a, b) from (key, t, u, id, own, label): links within a tile (t = u), or between two tiles."""
        met = dealt.join(self.known.select("id", "fp", "shingles"), "id").select("key", "t", "u", "id", "own", "label", "fp", "shingles")
        met = met.repartition("key", "t", "u").sortWithinPartitions("key", "t", "u", "id")
        words, bound, similarity = self.words, self.bound, self.similarity

        def run(batches: Iterator[pa.RecordBatch]):
            for table in _groups(batches, 3):
                starts = _starts(table, 3).tolist()
                for i, j in zip(starts, [*starts[1:], table.num_rows]):
                    group = table.slice(i, j - i).combine_chunks()
                    if group.num_rows < 2:
                        continue
                    t, u = group.column(1)[0].as_py(), group.column(2)[0].as_py()
                    fp = np.frombuffer(b"".join(group.column(6).to_pylist()), "<u8").reshape(-1, words)
                    sets = [np.frombuffer(x, "<u8") for x in group.column(7).to_pylist()]
                    _, label = np.unique(group.column(5).to_numpy(), return_inverse=True)
                    a, b = alike(fp, sets, bound, similarity, label, None if t == u else group.column(4).to_numpy())
                    ids = group.column(3).to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

        return met.mapInArrow(run, "a long, b long")

    def within(self, rows: DataFrame) -> DataFrame:
        """Links within tiles; a large group's tiles share its leaders."""
        sizes = self.tiles(rows, "key")
        rows = rows.join(sizes.where("rows > 1").select("key", "tiles"), "key")
        large = rows.where("tiles > 1")
        place = F.row_number().over(W.partitionBy("key").orderBy(F.xxhash64(F.lit("leader"), "id"), "id"))
        leaders = large.select("key", "id", "tiles", place.alias("p")).where(F.col("p") <= FAMILY_LEADERS)
        own = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
        each = rows.select("key", "id", own.alias("own")).union(leaders.select("key", "id", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("own"))).distinct()
        return self.decide(each.select("key", F.col("own").alias("t"), F.col("own").alias("u"), "id", "own", F.col("id").alias("label")))

    def across(self, rows: DataFrame) -> DataFrame:
        """Links between rows (key, id, n, label) of other labels: all rows but those of a group's largest label meet all rows."""
        counts = self.tiles(rows, "key", "label")
        most = counts.groupBy("key").agg(F.max(F.struct("rows", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
        rows = rows.join(most.select("key", F.col("main.label").alias("main")), "key").withColumn("minor", F.col("label") != F.col("main"))
        n = self.tiles(rows, "key", "minor").groupBy("key").agg(F.max(F.when(F.col("minor"), F.col("tiles"))).alias("r"), F.max(F.when(~F.col("minor"), F.col("tiles"))).alias("m"))
        rows = rows.join(n, "key")
        own = F.when(F.col("minor"), F.pmod(F.xxhash64("id"), F.col("r"))).otherwise(F.col("r") + F.pmod(F.xxhash64("id"), F.col("m"))).cast("int")
        others = F.when(F.col("minor"), F.sequence(F.lit(0), F.col("r") + F.col("m") - 1)).otherwise(F.sequence(F.lit(0), F.col("r") - 1))
        each = rows.select("key", "id", "label", own.alias("own"), F.explode(others).alias("other"))
        return self.decide(each.select("key", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"), "id", "own", "label"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, tile: int = BUCKET_TILE, family_tile: int = FAMILY_TILE) -> DataFrame:
    """(node, root) of rows that are near copies of others: texts whose sets of n-word shingles are ``similarity`` alike.

    Ids are whole numbers and differ by row; rows with a null id take no part.
    """
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text")).where("id is not null")
    bits, tables = plan(rows.select("id").count(), similarity, recall)
    words = -(-bits * tables // 64) + CHECK_WORDS

    def mark(batches: Iterator[pa.RecordBatch]):
        for part, texts in blocks(batches):
            sets = [np.unique(shingle_hashes(t, n)) for t in texts]
            fps = [x.tobytes() for x in long_fingerprints(sets, words).astype("<u8")]
            same = [xxhash.xxh3_128_digest(x.astype("<u8").tobytes()) for x in sets]
            sizes = pa.array(map(len, sets), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(same, pa.binary()), pa.array(fps, pa.binary())], ["id", "n", "same", "fp"])

    every = stage(rows.mapInArrow(mark, "id long, n long, same binary, fp binary"), "long-fingerprints")
    # equal sets are one row from here on
    first = stage(every.groupBy("same").agg(F.min("id").alias("id"), F.count("*").alias("rows")), "shingle-sets")
    again = first.where("rows > 1").select("same", F.col("id").alias("a"))
    twins = stage(every.select("same", F.col("id").alias("b")).join(again, "same").where("a <> b").select("a", "b"), "equal-sets")
    fps = every.join(twins.select(F.col("b").alias("id")), "id", "left_anti").select("id", "n", "fp")

    def deal(batches: Iterator[pa.RecordBatch]):
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                fp = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u8").reshape(-1, words)
                own = np.unpackbits(np.ascontiguousarray(fp[:, CHECK_WORDS:]).view(np.uint8), axis=1, bitorder="little")
                keys = own[:, : bits * tables].reshape(len(fp), tables, bits) @ weights | np.arange(tables, dtype=np.int64) << 48
                ids = np.repeat(part.column(0).to_numpy(), tables)
                checks = [np.repeat(fp[:, i].astype(np.int64), tables) for i in range(CHECK_WORDS)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.ravel(), ids, *checks)], ["key", "id", *checked])

    checked = [f"c{i}" for i in range(CHECK_WORDS)]
    keyed = "key long, id long, " + ", ".join(f"{c} long" for c in checked)
    dealt = fps.select("id", "fp").mapInArrow(deal, keyed)
    # rows of one family: linked by candidates, whether these pass or not
    families = connected_components(_bucket_links(dealt, bits_allowed(64 * CHECK_WORDS, similarity), tile))
    families = families.select(F.col("node").alias("id"), F.col("root").alias("key"))

    def spell(batches: Iterator[pa.RecordBatch]):
        for part, texts in blocks(batches):
            sets = [np.unique(shingle_hashes(t, n)).astype("<u8").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    spelled = rows.join(families.select("id"), "id", "left_semi").mapInArrow(spell, "id long, shingles binary")
    known = stage(spelled.join(every.select("id", "n", "fp"), "id"), "family-sets")
    judge = _Families(known, words, similarity, family_tile)
    members = families.join(known.select("id", "n"), "id")
    found = stage(judge.within(members).union(twins), "links-within")
    labels = connected_components(found)
    large = stage(judge.tiles(members, "key").where("tiles > 1"), "large-families")
    if not large.limit(1).count():
        return labels
    # what the tiles left apart
    apart = members.join(large.select("key", "rows"), "key").join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", "rows", F.coalesce("root", "id").alias("label"))
    apart = stage(apart, "large-family-rows")
    # in a family with more tiles outside its main part than there are blocks, the rows of each bucket meet: less to send
    parts = apart.groupBy("key", "label").agg(F.count("*").alias("of"), F.max("rows").alias("rows"))
    vast = parts.groupBy("key").agg((F.max("rows") - F.max("of")).alias("minor")).where(F.col("minor") > family_tile * tables)
    vast = stage(apart.join(vast.select("key"), "key", "left_semi").select("id", "label", "n"), "vast-families")
    met = apart.select("key", "id", "n", "label")
    if vast.limit(1).count():
        again = fps.join(vast, "id", "left_semi").select("id", "fp").mapInArrow(deal, keyed).select(-1 - F.col("key"), "id")
        met = met.join(vast.select("id"), "id", "left_anti").select("key", "id", "n", "label").union(again.toDF("key", "id").join(vast, "id").select("key", "id", "n", "label"))
    more = judge.across(stage(met, "rows-across"))
    return connected_components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns: of each group of near copies the row with its smallest id.

    Rows are told apart by a key of their own, so rows that share an id are judged each by its text, and of near copies
    that share the smallest id one row stays. Rows with a null id stay and take no part. Texts without a word (null,
    empty, blank) have equal, empty sets of shingles: of those with an id the smallest stays. A text of fewer words than a
    shingle is one shingle. An empty table gives an empty result. Tables made on the way are deleted.
    """
    key = fresh(docs, "kt_row")
    rows = stage(docs.withColumn(key, F.monotonically_increasing_id()), "near-dedup-rows")
    with tidied() as kept:
        groups = similar_groups(rows.where(quoted(id_col).isNotNull()), key, text_col, **how)
        named = stage(groups.join(rows.select(F.col(key).alias("node"), quoted(id_col).alias("id")), "node"), "near-groups")
        first = named.groupBy("root").agg(F.min(F.struct("id", "node"))["node"].alias("first"))
        gone = kept(stage(named.join(first, "root").where("node <> first").select(F.col("node").alias(key)), "near-copies"))
    return rows.join(gone, key, "left_anti").select(*[quoted(c) for c in docs.columns])
