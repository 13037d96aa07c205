"""Periodic runs of words: suffix array, longest previous factors, LZ blocks, boundary extensions and bucketed copying.

A run is a stretch of words with smallest period q, at least ``min_length`` words and ``min_exponent`` periods long, that
can't be extended by a word on either side.

A block of documents is worked on at once, each document's words being symbols of its own. Prefix doubling sorts the
suffixes (words whose rank is already alone drop out of later rounds); the ranks of each round are kept and answer by
how many words two places agree to the right or to the left. A run has a factor that occurs again one period later,
``min_length`` less a period long at least, so documents without a repeat of that length end there. For the others,
suffix array and LCP give each position's longest previous factor, and those give the LZ blocks. A run that touches the
start or end of a block has a whole period beside that boundary, of a length that the two adjacent blocks bound; both
sides are extended for each such period (Main). All other runs lie strictly inside a block and are copies of runs in the
block's earlier occurrence: runs lie in buckets by start, and buckets are copied from left to right.

Spark deals the rows (``mapInArrow``); nothing is shuffled. Memory goes with a block's words (``BLOCK_BYTES`` of text, or
one longer document) times the number of rounds.

Defined results
* words are ``[^\\x20\\x09-\\x0D]+``; null, empty or blank text: no words, no runs, an empty collapsed text;
* repeated rows are worked on each; a null id is passed on; an empty table gives an empty result; other columns are
  ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.common import quoted

BLOCK_BYTES = 6_000_000
#: Pairs of boundary and period that are looked at together.
PAIRS = 1_000_000
_SPACE = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r "))

#: Start and period from which on a document's words are replaced by copies (None: left alone), by id and number of words.
Rewrite = Callable[[object, int], tuple[int, int] | None]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in one array, and where each text's words begin in it (one more: the end)."""
    texts = texts.cast(pa.large_binary())
    sizes, data = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1], texts.buffers()[2]
    units = np.frombuffer(data, np.uint8)[sizes[0] : sizes[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = sizes - sizes[0]
    space = _SPACE[units]
    after = np.concatenate([[True], space[:-1]])[: len(units)]
    after[ends[:-1][ends[:-1] < len(units)]] = True
    starts = np.flatnonzero(~space & after)
    shown = np.cumsum(~space)
    offsets = np.append(shown[starts] - 1, shown[-1] if len(units) else 0).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(units[~space])])
    return words, np.searchsorted(starts, ends)


class Suffixes:
    """Suffix ranks of many documents by prefix doubling; ``levels[t]`` ranks the first 2^t words from each place on."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray):
        self.n = len(symbols)
        doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.doc, self.first, self.end = doc, starts[:-1][doc], starts[1:][doc]
        key = doc * (int(symbols.max(initial=0)) + 1) + symbols
        rank, self.active = self._ranked(np.arange(self.n), key, np.zeros(self.n, np.int64))
        self.levels = [rank.astype(np.int32)]

    def _ranked(self, at: np.ndarray, key: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the places ``at`` after sorting by ``key`` within their former ranks, and the places that still tie."""
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        fresh = np.append(True, key[1:] != key[:-1])[: len(at)]
        former = np.append(True, rank[at][1:] != rank[at][:-1])[: len(at)]
        index = np.arange(len(at))
        mine, whole = np.maximum.accumulate(np.where(fresh, index, 0)), np.maximum.accumulate(np.where(former, index, 0))
        new = rank.copy()
        new[at] = rank[at] + mine - whole
        tied = ~fresh | ~np.append(fresh[1:], True)[: len(at)]
        return new, at[tied]

    def double(self) -> None:
        rank, at, step = self.levels[-1].astype(np.int64), self.active, 1 << (len(self.levels) - 1)
        then = at + step
        second = np.where(then < self.end[at], rank[np.minimum(then, self.n - 1)], -1)
        rank, self.active = self._ranked(at, rank[at] * (self.n + 1) + second + 1, rank)
        self.levels.append(rank.astype(np.int32))

    def restrict(self, keep: np.ndarray) -> None:
        """Only the places of some documents stay."""
        place = np.cumsum(keep) - 1
        size = np.bincount(self.doc[keep])
        size = size[size > 0]
        starts = np.append(0, np.cumsum(size))
        self.levels, self.active, self.n = [x[keep] for x in self.levels], place[self.active[keep[self.active]]], int(keep.sum())
        # ranks keep their order; closing the gaps keeps them below n
        self.levels = [np.searchsorted(np.sort(x), x, "left").astype(np.int32) for x in self.levels]
        self.doc = np.repeat(np.arange(len(size)), size)
        self.first, self.end = starts[:-1][self.doc], starts[1:][self.doc]

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that the suffixes at x and y (different places of one document, or its end) have in common."""
        found, stop_x, stop_y = np.zeros(len(x), np.int64), self.end[np.minimum(x, self.n - 1)], self.end[np.minimum(y - 1, self.n - 1)]
        for t in range(len(self.levels) - 1, -1, -1):
            a, b = x + found, y + found
            same = (a + (1 << t) <= stop_x) & (b + (1 << t) <= stop_y)
            same &= self.levels[t][np.minimum(a, self.n - 1)] == self.levels[t][np.minimum(b, self.n - 1)]
            found += same.astype(np.int64) << t
        return found

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Words that the texts before x and y, x before y, have in common at their ends."""
        found, start = np.zeros(len(x), np.int64), self.first[np.minimum(x, self.n - 1)]
        for t in range(len(self.levels) - 1, -1, -1):
            a, b = x - found - (1 << t), y - found - (1 << t)
            same = a >= start
            same &= self.levels[t][np.maximum(a, 0)] == self.levels[t][np.maximum(b, 0)]
            found += same.astype(np.int64) << t
        return found


def previous_factors(suffixes: Suffixes) -> tuple[list[int], list[int]]:
    """Longest previous factor of every place, and where it occurs earlier, from suffix array and LCP by one stack pass."""
    order = np.argsort(suffixes.levels[-1], kind="stable")
    same = suffixes.doc[order[1:]] == suffixes.doc[order[:-1]]
    shared = np.zeros(len(order), np.int64)
    x, y = np.minimum(order[1:], order[:-1])[same], np.maximum(order[1:], order[:-1])[same]
    shared[1:][same] = suffixes.ahead(x, y)
    longest, source = [0] * len(order), [-1] * len(order)
    stack: list[tuple[int, int]] = []
    for place, lcp in zip([*order.tolist(), -1], [*shared.tolist(), 0]):
        while stack and place < stack[-1][0]:  # both neighbours of smaller place are known now
            top, left = stack.pop()
            longest[top], source[top] = (left, stack[-1][0] if stack else -1) if left >= lcp else (lcp, place)
            lcp = min(left, lcp)
        stack.append((place, lcp))
    return longest, source


def _spans(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, 1..size[i]) for all i."""
    i = np.repeat(np.arange(len(size)), size)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(size) - size, size) + 1


def find_runs(symbols: np.ndarray, starts: np.ndarray, min_length: int = 24, min_exponent: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of documents given as one sequence: document, start in it, length, period; sorted by document, start, period."""
    none = (np.zeros(0, np.int64),) * 4
    if len(symbols) == 0:
        return none
    least = min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1))  # words that come again a period later
    suffixes = Suffixes(symbols, starts)
    while len(suffixes.active) and len(suffixes.levels) < least.bit_length():
        suffixes.double()
    if not len(suffixes.active):
        return none
    alive = np.zeros(len(starts) - 1, bool)
    alive[suffixes.doc[suffixes.active]] = True
    names = np.flatnonzero(alive)
    suffixes.restrict(alive[suffixes.doc])
    while len(suffixes.active):
        suffixes.double()
    longest, source = previous_factors(suffixes)

    # LZ blocks: as long as the longest previous factor, or one new word
    at, blocks = 0, []
    while at < suffixes.n:
        blocks.append(at)
        at += longest[at] or 1
    start = np.array(blocks)
    size = np.diff(np.append(start, suffixes.n))

    # every boundary with the sizes of the blocks on its two sides; a document's end has none on its right
    doc = suffixes.doc[start]
    opens = np.append(True, doc[1:] != doc[:-1])
    closes = np.append(opens[1:], True)
    inner = np.flatnonzero(~opens)
    bound = np.concatenate([start[inner], (start + size)[closes]])
    left, right = np.concatenate([size[inner - 1], size[closes]]), np.concatenate([size[inner], np.zeros(closes.sum(), np.int64)])
    first, end = suffixes.first[bound - 1], suffixes.end[bound - 1]
    near = max(1, least // 2)
    level = near.bit_length() - 1  # one side agrees over at least so many words
    found = []
    tasks = [(bound, np.minimum(left + right, bound - first), 0), (bound, np.minimum(right, end - bound), 1)]
    for edges, reach, side in tasks:
        cuts = np.searchsorted(np.cumsum(reach), np.arange(PAIRS, reach.sum() + PAIRS, PAIRS), "left") + 1
        for a, b in zip(np.append(0, cuts[:-1]), cuts):
            i, q = _spans(reach[a:b])
            x = edges[a:b][i] - (0 if side else q)
            y = x + q
            ranks, width = suffixes.levels[min(level, len(suffixes.levels) - 1)], 1 << min(level, len(suffixes.levels) - 1)
            stop, begin = end[a:b][i], first[a:b][i]
            hit = (y + width <= stop) & (ranks[np.minimum(x, suffixes.n - 1)] == ranks[np.minimum(y, suffixes.n - 1)])
            hit |= (x - width >= begin) & (ranks[np.maximum(x - width, 0)] == ranks[np.maximum(y - width, 0)])
            x, y, q = x[hit], y[hit], q[hit]
            back, on = suffixes.behind(x, y), suffixes.ahead(x, y)
            long = back + on + q >= np.maximum(min_length, min_exponent * q)
            found.append(np.stack([x - back, x + on + q, q])[:, long])
    runs = np.concatenate(found, 1)
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    once = np.append(True, (runs[:2, 1:] != runs[:2, :-1]).any(0))[: runs.shape[1]]  # multiples of a period give the same stretch
    runs = runs[:, once]

    # runs strictly inside a block: copied from its source
    buckets: dict[int, list[tuple[int, int]]] = {}
    for i, j, q in runs.T.tolist():
        buckets.setdefault(i, []).append((j - i, q))
    has_runs = set(suffixes.doc[runs[0]].tolist())
    for b, ln in zip(start.tolist(), size.tolist()):
        if ln >= min_length + 2 and int(suffixes.doc[b]) in has_runs:
            src = source[b]
            stop = src + ln
            for p in range(src + 1, stop - min_length):
                for n, q in buckets.get(p, ()):
                    if p + n < stop:
                        buckets.setdefault(p + b - src, []).append((n, q))
    rows = np.array(sorted((i, q, n) for i, some in buckets.items() for n, q in some), np.int64).reshape(-1, 3)
    at = rows[:, 0]
    return names[suffixes.doc[at]], at - suffixes.first[at], rows[:, 2], rows[:, 1]


def collapse(words: pa.Array, starts: np.ndarray, runs: tuple[np.ndarray, ...]) -> pa.Array:
    """Each document's words without those that a run holds after its first period, joined by one space."""
    doc, begin, length, period = runs
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts[doc] + begin + period, 1)
    np.add.at(edge, starts[doc] + begin + length, -1)
    keep = np.cumsum(edge)[:-1] == 0
    kept = np.append(0, np.cumsum(keep))[starts]
    listed = pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), words.filter(pa.array(keep)) if not keep.all() else words)
    return pc.binary_join(listed, pa.scalar(" ", pa.large_string())).cast(pa.string())


def periodic_runs(docs: DataFrame, min_length: int = 24, min_exponent: int = 3, rewrite: Rewrite | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, runs (array of start, length, period, sorted by start and period) and collapsed (text).

    ``collapsed`` joins the words that no run holds after its first period. ``rewrite`` plants repeats first: given an id
    and a number of words it names a place a and a period p; word i >= a then becomes word a + (i - a) % p.
    """
    if min_length < 2 or min_exponent < 2:
        raise ValueError("runs have at least two words and two periods")
    rows = docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, starts = split_words(batch.column(1))
        if rewrite is not None:
            take, sizes = np.arange(len(words)), np.diff(starts)
            for doc_id, n, first in zip(batch.column(0).to_pylist(), sizes.tolist(), starts.tolist()):
                if (plan := rewrite(doc_id, n)) is not None:
                    a, p = plan
                    take[first + a : first + n] = first + a + np.arange(n - a) % p
            words = words.take(pa.array(take))
        runs = find_runs(words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), starts, min_length, min_exponent)
        ends = np.append(0, np.cumsum(np.bincount(runs[0], minlength=batch.num_rows)))
        listed = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in runs[1:]], ["start", "length", "period"])
        arrays = [batch.column(0), pa.array(np.diff(starts), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed), collapse(words, starts, runs)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            size = np.cumsum(np.append(0, np.asarray(pc.binary_length(batch.column(1)), np.int64)))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, size[at] + BLOCK_BYTES, "right")) - 1)
                yield work(batch.slice(at, to - at))
                at = to

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact exponent (ties: smallest start, then period); NULL without runs."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.reduce(runs, none, lambda best, x: F.when(best.isNull() | more(x, best), x).otherwise(best))
