"""Packing with a controlled mixture: deficit round-robin over source queues.

Each source is a queue of tokens: its documents in order, cut wherever a window ends. In every round each queue earns
its share of a window; what it is owed beyond whole tokens stays with it as its deficit and is served in a later
window. Serving, token by token, the queue whose next token is due first is the limit of that scheme with the smallest
quantum; after any number of windows a queue is less than one token off its share per queue that competes with it. A
queue that runs dry leaves the round, and the others go on in their proportions.

That order has a closed form: the number of tokens that queue k has sent by time t is min(T_k, round(w_k t)). So the
state at any window (all queues' positions, deficits included) is found by bisection on t without playing the windows
before it, and every partition packs its own documents: deficits are carried across windows and partitions without
a sequential pass. Only windows that a document's tokens can lie in are looked at, in bounded tables.

Flow: tokenise (each task also keeps a running total per source), write ids to the shared folder, add up one row for
each task and source, and cut each document at the windows' ends. Texts and ids aren't shuffled unless the table of
running totals outgrows Spark's broadcast threshold.

Defined results
* null or empty text: just the end id; repeated rows are packed each; a null source is a queue of its own;
* sources that ``targets`` names and the largest, ``max_queues`` in all, have queues of their own; the others are dealt
  to about as many shared queues as each has sources, and a shared queue serves its sources by the same scheme, so
  every source keeps a deficit of its own;
* an empty table gives an empty result; other columns are ignored, whatever their names;
* all sequences are full but the last one, which is padded.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinetrail.llm.byte_bpe import blocks
from kinetrail.llm.common import held, quoted, stage

WINDOW = 4096
END_ID = 2
MAX_QUEUES = 255
#: Numbers in a table of windows by queues that a task holds at once.
CELLS = 500_000
#: Pieces of words that a worker remembers in each of two generations, and the longest among them: some 300 MB at most.
CACHE_PIECES, CACHE_CHARS = 800_000, 64
#: Characters of text that are tokenised at a time.
BLOCK_CHARS = 3_000_000
#: How the tokenizer cuts text into pieces that it encodes apart, and the same for lower-case Latin-1.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = re.compile("[a-zªµºß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9²³¹¼-¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼-¾\t-\r \x85\xa0]+")
#: Separators that str.split takes for white space and the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")
#: Beyond Latin-1, lower-casing differs between libraries for some characters.
_WIDE = re.compile("[^\x00-\xff]")


def _latin(text: str) -> bool:
    return text.isascii() or not _WIDE.search(text)


def pieces(text: str) -> list[str]:
    """Parts of a text that are encoded apart, in order: finer than words, as forms of one word share them."""
    if _latin(text):  # lower case first where Python and the tokenizer agree on it
        return _PIECES.findall(text.lower())
    return list(chain.from_iterable(_PIECES.findall(w.lower()) if _latin(w) else [w] for w in text.split()))


class WordTokenizer:
    """Ids of a tokenizers file whose tokens never span white space, with a bounded cache of encoded pieces."""

    most_pieces = CACHE_PIECES

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        ends = [i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]
        self.closes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.closes[ends] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        norm, pre = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        cuts = json.loads(pre.__getstate__()).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex") if pre else None
        #: other tokenizers' texts are cut at white space only
        self.finer = cuts == _CUTS and norm is not None and norm.normalize_str("Aß É") == "aß é"
        self.cache, self.old_cache = {}, {}

    def _age(self) -> None:
        """A full cache becomes the old generation; what is still in use comes back from it, the rest goes with the next."""
        if len(self.cache) > self.most_pieces:
            self.cache, self.old_cache = {}, self.cache

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            flat = np.fromiter((x for e in ids for x in e), self.kind).tobytes()
            width, at = int(self.kind[-1]), 0
            for w, e in zip(part, ids):
                self.cache[w] = flat[at : (at := at + len(e) * width)]

    def _learn_whole(self, words: list[str]) -> None:
        """Pieces that the tokenizer doesn't split: many go in as one text, and the tokens that close a word part them again."""
        width, odd = int(self.kind[-1]), []
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            flat = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            ends = (np.flatnonzero(self.closes[flat]) + 1) * width
            if len(ends) != len(part):
                odd += part
                continue
            raw, start = flat.tobytes(), 0
            for w, stop in zip(part, ends.tolist()):
                self.cache[w] = raw[start:stop]
                start = stop
        self._learn(odd)

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        whole = {t for t in texts if _ODD.search(t) or any(a in t for a in self.added)}
        cut = [[t] if t in whole else pieces(t) if self.finer else t.split() for t in texts]
        self._age()
        cache, old, plain, rest = self.cache, self.old_cache, [], []
        for p in set().union(*cut):
            if p not in cache:
                if (ids := old.get(p)) is not None:
                    cache[p] = ids
                else:
                    (plain if self.finer and p not in whole and _latin(p) else rest).append(p)
        self._learn_whole(plain)
        self._learn(rest)
        last = np.array([end], self.kind).tobytes()
        found = [b"".join(map(cache.__getitem__, c)) + last for c in cut]
        for p in chain(plain, rest):
            if len(p) > CACHE_CHARS:  # too long to remember
                del cache[p]
        return found


def tokenizer(path: str, remembered: float = 1.0) -> WordTokenizer:
    found = held("packing", path, WordTokenizer)
    found.most_pieces = int(CACHE_PIECES * remembered)
    return found


def tokenise(docs: DataFrame, path: str, id_col: str, text_col: str, source_col: str, end: int, remembered: float = 1.0) -> DataFrame:
    """doc_id, source, part, before (tokens of the same source earlier in the task), n, ids (binary)."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"), quoted(source_col).cast("string").alias("source"))

    def run(batches: Iterator[pa.RecordBatch]):
        enc, part, total = tokenizer(path, remembered), TaskContext.get().partitionId(), {}
        width = int(enc.kind[-1])
        for batch, texts in blocks(batches, chars=max(1, int(BLOCK_CHARS * remembered))):
            ids = enc.encode(texts, end)
            before, counts = [], [len(x) // width for x in ids]
            for source, n in zip(batch.column(2).to_pylist(), counts):
                before.append(total.get(source, 0))
                total[source] = before[-1] + n
            arrays = [batch.column(0), batch.column(2), pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "source", "part", "before", "n", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, source string, part int, before long, n long, ids binary")


class Mixture:
    """Positions of all queues once a number of tokens is sent. ``totals``: tokens by queue; ``weights``: target proportions."""

    def __init__(self, totals: list[int], weights: list[float], window: int = WINDOW):
        self.totals, self.weights, self.window = np.array(totals, np.int64), np.array(weights, np.float64), window
        self.sum = int(self.totals.sum())
        self.end = float((self.totals / self.weights).max()) * (1 + 1e-9) + 1e-9

    def sent(self, t: np.ndarray) -> np.ndarray:
        """Tokens that each queue has sent by time t: times x queues."""
        return np.minimum(self.totals, np.floor(t[:, None] * self.weights + 0.5).astype(np.int64))

    def at(self, goal: np.ndarray) -> np.ndarray:
        """Queue positions when ``goal`` tokens are sent in all: goals x queues. Rows add up to their goals."""
        goal = np.minimum(goal, self.sum)
        low, high = np.zeros(len(goal)), np.full(len(goal), self.end)
        for _ in range(70):
            mid = (low + high) / 2
            below = self.sent(mid).sum(1) <= goal
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        at, top = self.sent(low), self.sent(high)
        short = (goal - at.sum(1))[:, None]  # due at the same time: earlier queues first
        gap = top - at
        return at + np.clip(short - (np.cumsum(gap, 1) - gap), 0, gap)

    def starts(self, first: int, last: int) -> np.ndarray:
        """Queue positions at the starts of windows first..last: windows x queues."""
        return self.at(np.arange(first, last + 1, dtype=np.int64) * self.window)

    def ranks(self, queue: np.ndarray | int, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of how many tokens are sent before these tokens of their queues."""
        t, k = (token + 0.5) / self.weights[queue], len(self.totals) + 1
        near = np.concatenate([self.sent(x).sum(1) for x in np.split(t, range(CELLS // k + 1, len(t), CELLS // k + 1))])
        return np.maximum(near - k, 0), np.minimum(near + k, self.sum)


def _each(row: tuple, mix: Mixture) -> np.ndarray:
    """Windows that surely cover a row's tokens, sought for each token."""
    queue, start, stop, inner, index = row
    low = high = np.arange(start, stop)
    if inner is not None:
        low, high = inner.ranks(index, low)
    low, high = mix.ranks(queue, low)[0] // mix.window, mix.ranks(queue, high)[1] // mix.window
    return np.unique(np.concatenate([low + i for i in range(int((high - low).max()) + 1)]))


def cut(batch: pa.RecordBatch, mix: Mixture, kind: str) -> pa.RecordBatch:
    """The pieces of a batch of (doc_id, source, queue, start, n, ids, index, totals, weights).

    ``queue`` is one of the mixture's; a queue of several sources is itself a mixture, with ``totals`` and ``weights``
    by source, of which this row's source is number ``index``.
    """
    inners: dict[int, Mixture] = {}
    rows, todo = [], []
    queues, starts, sizes, indexes = (batch.column(c).to_pylist() for c in (2, 3, 4, 6))
    ends = np.array([starts, [a + n - 1 for a, n in zip(starts, sizes)]], np.int64)  # first and last token
    low, high = ends[0].copy(), ends[1].copy()
    for i, (queue, start, n, index) in enumerate(zip(queues, starts, sizes, indexes)):
        if index is not None:
            if queue not in inners:
                inners[queue] = Mixture(batch.column(7)[i].as_py(), batch.column(8)[i].as_py())
            low[i], high[i] = inners[queue].ranks(index, ends[:1, i])[0][0], inners[queue].ranks(index, ends[1:, i])[1][0]
        rows.append((queue, start, start + n, inners.get(queue), index))
    low, high = mix.ranks(np.array(queues), low)[0] // mix.window, mix.ranks(np.array(queues), high)[1] // mix.window
    step, last = max(1, CELLS // len(mix.totals)), -(-mix.sum // mix.window)
    for i, (a, b, n) in enumerate(zip(low.tolist(), high.tolist(), sizes)):
        # all windows between the first and the last token's, or those of each token if that is less
        wanted = np.arange(a, b + 1) if b - a <= 4 * n + 64 else _each(rows[i], mix)
        wanted = wanted[wanted < last]
        todo += [(i, wanted[k : k + step]) for k in range(0, len(wanted), step)]
    todo.sort(key=lambda x: int(x[1][0]))
    out: list[tuple] = []
    ids, at = batch.column(5), 0
    while at < len(todo):  # as many rows at once as the table of edges has room for
        some, size = [], 0
        while at < len(todo) and (not some or (size + len(todo[at][1])) * len(mix.totals) <= CELLS):
            some.append(todo[at])
            size += len(todo[at][1])
            at += 1
        windows = np.unique(np.concatenate([w for _, w in some]))
        marks = np.unique(np.concatenate([windows, windows + 1]))
        edges = mix.at(marks * mix.window)
        here = np.searchsorted(marks, windows)
        sizes = edges[here + 1] - edges[here]
        lead = np.cumsum(sizes, 1) - sizes  # where a queue's tokens begin within the window
        for i, mine in some:
            queue, start, stop, inner, index = rows[i]
            k = np.searchsorted(windows, mine)
            low, high, offset = edges[here[k], queue], edges[here[k] + 1, queue], lead[k, queue]
            if inner is not None:
                both = inner.at(np.concatenate([low, high]))
                sizes_in = both[len(low) :] - both[: len(low)]
                offset = offset + sizes_in[:, :index].sum(1)
                low, high = both[: len(low), index], both[len(low) :, index]
            a, b = np.maximum(low, start), np.minimum(high, stop)
            hit = np.flatnonzero(b > a)
            tokens = np.frombuffer(ids[i].as_buffer(), kind).astype("<u4")
            for w, x, y, o in zip(mine[hit].tolist(), (a[hit] - start).tolist(), (b[hit] - start).tolist(), (offset + a - low)[hit].tolist()):
                out.append((i, x, y - x, zlib.crc32(tokens[x:y]), stop - start, w, o))
    picked, *cols = zip(*out) if out else [()] * 7
    take = pa.array(picked, pa.int64())
    named = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([batch.column(0).take(take), *[pa.array(c, pa.int64()) for c in cols], batch.column(1).take(take)], ["doc_id", *named, "source"])


def pack(
    docs: DataFrame,
    path: str,
    targets: dict[str | None, float] | None = None,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    end: int = END_ID,
    max_queues: int = MAX_QUEUES,
    power: float = 1.0,
    remembered: float = 1.0,
) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``targets``: wanted shares of tokens by source (any scale; unlisted sources keep the weight of their size
    relative to the smallest listed weight). Without it, a source's share of a window goes with its tokens to the
    ``power``: at 1 every window mirrors the corpus, below it small sources are drawn up until they run dry.
    ``remembered``: below 1 a worker remembers fewer pieces of words and tokenises smaller blocks, for executors whose memory
    other stages fill; it costs time and changes no result.
    """
    targets = targets or {}
    if any(w <= 0 for w in targets.values()):
        raise ValueError("targets are above 0")
    tokens = stage(tokenise(docs, path, id_col, text_col, source_col, end, remembered), "tokens")
    chunks = stage(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "token-totals")
    sources = chunks.groupBy("source").agg(F.sum("n").alias("n"))
    whole = sources.agg(F.sum("n")).first()[0] or 0
    least = min(targets.values()) if targets else 1.0
    sources = stage(sources.withColumn("weight", F.pow(F.col("n") / float(whole or 1), F.lit(float(power))) * least), "source-totals")
    is_listed = F.lit(False)
    for name in targets:
        is_listed = is_listed | F.col("source").eqNullSafe(F.lit(name))
    # at most max_queues rows, and those that targets name, reach the driver, whatever the number of sources
    listed = sources.where(is_listed).orderBy(F.asc_nulls_first("source")).collect() if targets else []
    top = listed + sources.where(~is_listed).orderBy(F.desc("n"), F.asc_nulls_first("source")).limit(max(1, max_queues - len(listed))).collect()
    names, totals = [r["source"] for r in top], [r["n"] for r in top]
    weights = [float(targets.get(r["source"], r["weight"])) for r in top]
    queue = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(names))):
        queue = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(i)).otherwise(queue)
    sources = sources.withColumn("queue", queue)
    tail = sources.where("queue is null")
    if (left := tail.count()) > 0:  # about as many shared queues as sources in each; a shared queue is a mixture itself
        shared = len(names) + F.pmod(F.xxhash64("source"), F.lit(int(np.ceil(np.sqrt(left))))).cast("int")
        tail = tail.withColumn("queue", shared).groupBy("queue").agg(F.sort_array(F.collect_list(F.struct("source", "n", "weight"))).alias("m"))
        tail = stage(tail.orderBy("queue").withColumn("place", F.row_number().over(W.orderBy("queue")) - 1 + len(names)), "shared-queues")
        for r in tail.select("place", F.aggregate("m", F.lit(0).cast("long"), lambda x, m: x + m["n"]).alias("n"), F.aggregate("m", F.lit(0.0), lambda x, m: x + m["weight"]).alias("w")).orderBy("place").collect():
            totals.append(r["n"])
            weights.append(r["w"])
        members = tail.select("place", F.posexplode("m").alias("index", "x"), F.col("m.n").alias("totals"), F.col("m.weight").alias("weights"))
        members = members.select(F.col("x.source").alias("source"), F.col("place").alias("queue"), "index", "totals", "weights")
    else:
        members = None
    mix = Mixture(totals or [1], weights or [1.0], window)

    # where a task's tokens of a source begin: one row for each task and source
    w = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = chunks.select(F.col("source").alias("of_source"), F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(w), F.lit(0).cast("long")).alias("base"))
    bases = stage(bases, "source-bases")
    on = tokens["source"].eqNullSafe(bases["of_source"]) & (tokens["part"] == bases["of_part"])
    placed = tokens.join(bases, on).select("doc_id", "source", queue.alias("queue"), (F.col("base") + F.col("before")).alias("start"), "n", "ids")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("index", "int"), ("totals", "array<long>"), ("weights", "array<double>"))]
    if members is None:
        placed = placed.select("*", *none)
    else:
        rare = placed.where("queue is null").drop("queue").join(members.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        placed = placed.where("queue is not null").select("*", *none).union(rare.select("doc_id", "source", "queue", "start", "n", "ids", "index", "totals", "weights"))

    def run(batches: Iterator[pa.RecordBatch]):
        kind = tokenizer(path, remembered).kind
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                yield cut(batch.slice(i, 1000), mix, kind)

    named = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
    return placed.mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, {named}")
