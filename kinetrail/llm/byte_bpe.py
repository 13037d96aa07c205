"""Byte-level BPE by a hierarchical-bitmap rank queue.

``RankQueue`` holds one bucket of linked-list positions for each merge rank, and three levels of bitmaps over the
ranks; find-first-set on them gives the lowest rank that waits. All pre-tokens of a block lie in one linked list with
walls between them, so one sweep over the ranks encodes the whole block: each bucket is merged as a vector, entries
that went stale (their pair has changed since) are skipped, and the pairs that a merge makes go to their own buckets.
A pre-token of any length costs what its merges cost, never the square of its length.

Merging a whole bucket at once equals merging its places one by one from the left: with ranks of a trained vocabulary
a merge never makes a pair of lower rank, and of places that overlap (runs of one token) every second is taken.

Texts are cut at the starts of white-space runs, where the split pattern always cuts too; each cut piece is looked up
in a bounded cache of encoded pieces, and only new ones are split by the pattern and encoded.

Spark deals the rows (``mapInArrow``): blocks of about ``BLOCK_CHARS`` characters bound the memory of a task.

Defined results
* null text counts as empty: no tokens, the digest of nothing; repeated rows are encoded each; an empty table gives an
  empty result; other columns are ignored, whatever their names; lone surrogates can't occur in Spark's UTF-8 strings.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from kinetrail.llm.common import quoted

#: Fixed value: what the Unicode property White_Space holds; the split pattern's \s.
SPACE = "\t-\r \x85\xa0  -     　"
BLOCK_CHARS = 6_000_000
#: A worker remembers so many pieces of at most so many characters.
CACHE_PIECES, CACHED_CHARS = 500_000, 64
NONE = np.int32(2**31 - 1)


class RankQueue:
    """Buckets by rank under three levels of 64-bit bitmaps."""

    def __init__(self, n_ranks: int):
        self.words = [0] * (n_ranks // 64 + 1)
        self.upper = [0] * (len(self.words) // 64 + 1)
        self.top = 0
        self.buckets: dict[int, list] = {}

    def bucket(self, rank: int) -> list:
        found = self.buckets.get(rank)
        if found is None:
            found = self.buckets[rank] = []
            word = rank >> 6
            self.words[word] |= 1 << (rank & 63)
            self.upper[word >> 6] |= 1 << (word & 63)
            self.top |= 1 << (word >> 6)
        return found

    def pop(self) -> tuple[int, list] | None:
        """The lowest rank that has a bucket, by find-first-set at each level."""
        if not self.top:
            return None
        high = (self.top & -self.top).bit_length() - 1
        upper = self.upper[high]
        word = (high << 6) + (upper & -upper).bit_length() - 1
        bits = self.words[word]
        rank = (word << 6) + (bits & -bits).bit_length() - 1
        self.words[word] = bits & (bits - 1)
        if not self.words[word]:
            self.upper[high] &= ~(1 << (word & 63))
            if not self.upper[high]:
                self.top &= ~(1 << high)
        return rank, self.buckets.pop(rank)


class ByteBPE:
    """Encoder and decoder for a file of ranks (base64 bytes, rank) as tiktoken reads it."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern)
        self.pieces = regex.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.n = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # a pair merges if its bytes together are in the vocabulary
        pairs = {(ranks[t[:i]] << 32 | ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pair_keys = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.pair_ranks = np.fromiter((pairs[k] for k in self.pair_keys.tolist()), np.int32, len(pairs))
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE) if len(self.pair_keys) else np.full(len(keys), NONE)

    def encode_tokens(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each pre-token (not empty), all in one sweep of the queue."""
        if not words:
            return []
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        ends = np.cumsum([len(w) for w in words])
        sym = self.byte[raw]
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends - 1] = n  # a wall: nothing follows within the pre-token
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[ends[:-1]] = -1
        pair = np.full(n + 1, NONE, np.int32)  # the rank of the pair that begins here; the last cell is the wall's
        inner = np.flatnonzero(after < n)
        pair[inner] = self.ranks_of(sym[inner], sym[inner + 1])
        alive = np.ones(n, bool)
        queue = RankQueue(self.n)
        order = inner[np.argsort(pair[inner], kind="stable")].astype(np.int32)
        order = order[: np.searchsorted(pair[order], NONE)]
        found, starts = np.unique(pair[order], return_index=True)
        for rank, block in zip(found.tolist(), np.split(order, starts[1:])):
            queue.bucket(rank).append(block)
        while (popped := queue.pop()) is not None:
            rank, bucket = popped
            whole = [x for x in bucket if isinstance(x, np.ndarray)]
            loose = [x for x in bucket if not isinstance(x, np.ndarray)]
            at = np.concatenate([*whole, np.array(loose, np.int32)]) if loose else whole[0]
            at = at[pair[at] == rank]  # stale entries
            if not len(at):
                continue
            if loose:
                at = np.unique(at)
            right = after[at]
            if len(at) > 1 and (touch := right[:-1] == at[1:]).any():
                touch = np.concatenate(([False], touch))
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(touch, 0, np.arange(len(at))))
                at = at[run % 2 == 0]
                right = after[at]
            follows = after[right]
            sym[at] = rank
            after[at] = follows
            alive[right] = False
            pair[right] = NONE
            inside = follows < n
            before[follows[inside]] = at[inside]
            made = np.full(len(at), NONE, np.int32)
            made[inside] = self.ranks_of(sym[at[inside]], sym[follows[inside]])
            pair[at] = made
            left = before[at]
            has = left >= 0
            left, mine = left[has], at[has]
            made_left = self.ranks_of(sym[left], sym[mine])
            pair[left] = made_left
            for places, made in ((at, made), (left, made_left)):
                good = made != NONE
                for r, p in zip(made[good].tolist(), places[good].tolist()):
                    queue.bucket(r).append(p)
        ids = sym[alive]
        counts = np.add.reduceat(alive, np.concatenate(([0], ends[:-1])), dtype=np.int64)
        return np.split(ids, np.cumsum(counts)[:-1])

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that the cache doesn't hold."""
        if len(self.cache) + len(pieces) > CACHE_PIECES:
            self.cache.clear()
        if len(self.words) > CACHE_PIECES:
            self.words.clear()
        split = {p: self.split.findall(p) for p in pieces}
        new = list({w for ws in split.values() for w in ws} - self.words.keys())
        for w, ids in zip(new, self.encode_tokens([w.encode() for w in new])):
            self.words[w] = ids.astype("<u4").tobytes()
        get = self.words.__getitem__
        for p, ws in split.items():
            self.cache[p] = b"".join(map(get, ws))
        for w in new:
            if len(w) > CACHED_CHARS:
                del self.words[w]

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [self.pieces.findall(t) for t in texts]
        new = set().union(*cut).difference(self.cache)
        if new:
            if len(self.cache) + len(new) > CACHE_PIECES:  # what this block needs must be there together
                new = set().union(*cut)
                self.cache.clear()
            self.learn(new)
        get = self.cache.__getitem__
        ids = [b"".join(map(get, pieces)) for pieces in cut]
        for p in new:
            if len(p) > CACHED_CHARS:
                del self.cache[p]
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[str, str], ByteBPE] = {}


def codec(path: str, pattern: str) -> ByteBPE:
    """One codec a worker process; its tables and cache are reused by the tasks that follow."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE(path, pattern)
    return _loaded[path, pattern]


def blocks(batches: Iterator[pa.RecordBatch], text_at: int = 1, chars: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with at most about ``chars`` bytes of text (a longer text stands alone), and their texts."""
    for batch in batches:
        sizes = np.asarray(pa.compute.binary_length(batch.column(text_at)).fill_null(0))
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > chars:
                yield (part := batch.slice(start, i - start)), [t or "" for t in part.column(text_at).to_pylist()]
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield (part := batch.slice(start)), [t or "" for t in part.column(text_at).to_pylist()]


def bpe_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 (ids as little-endian unsigned 32-bit integers)."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))

    def run(batches):
        bpe = codec(path, pattern)
        for part, texts in blocks(batches):
            ids = bpe.encode_block(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and ids array<int>."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))

    def run(batches):
        bpe = codec(path, pattern)
        for part, texts in blocks(batches):
            ids = pa.array([np.frombuffer(x, "<i4") for x in bpe.encode_block(texts)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def bpe_decode(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id and the decoded bytes; null ids decode to nothing, an unknown id fails the job."""
    rows = rows.select(quoted(id_col).alias("doc_id"), quoted(ids_col).alias("ids"))

    def run(batches):
        bpe = codec(path, pattern)
        for part in batches:
            out = [b"".join(map(bpe.bytes_of.__getitem__, x or ())) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")
