"""Token counts by a map-side lookup in two tiers; no pre-token is ever shuffled.

Byte-level BPE never merges across pre-tokens, so a text's count is the sum of its pre-tokens' counts. The first tier is
a table of frequent pre-tokens and their counts, packed into one string and one byte array and broadcast; a worker
unpacks it into a hash table once. What it lacks is looked up in the worker's own cache, and only pre-tokens that
neither knows are encoded. The cache has two generations of bounded size: what is still in use moves on, the rest goes.

The table's bound is ``entries`` pre-tokens of at most ``LONGEST`` characters (about 2 MB), whatever the corpus. Its
entries come from a bounded random sample of rows (``sample_rows``); each of at most ``SKETCHES`` tasks returns its most
frequent ones. The sample decides what is looked up first, never a count: any table, also an empty one, gives the same
result.

Special strings inside a text are tokens of their own, as the library takes them by default.

Defined results
* null text counts as empty: no bytes, no tokens; pre-tokens of any length are encoded whole (over ``LONGEST``
  characters they are not remembered); repeated rows are counted each;
* an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from kinetrail.llm.byte_bpe import blocks
from kinetrail.llm.common import quoted

SAMPLE_ROWS, ENTRIES, SKETCHES = 4_000, 32_768, 8
LONGEST = 48
#: Pre-tokens that a worker remembers in each of two generations: some 150 MB at most.
CACHE = 500_000
BLOCK_CHARS = 3_000_000


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PreTokens:
    """The pre-tokens of a byte-level tokenizers file, and their numbers of tokens."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        pre, added = told["pre_tokenizer"] or {}, told["added_tokens"]
        if told["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a file with byte-level pre-tokens, without normalizer and prefix space")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("special strings that look at what is around them aren't supported")
        self.model = Tokenizer.from_file(path).model
        self.letters = _byte_letters()
        self.split = regex.compile(pattern).findall
        strings = sorted((t["content"] for t in added), key=lambda s: (-len(s), s))
        self.special = regex.compile("|".join(map(regex.escape, strings))) if strings else None
        self.table: dict[str, int] = {}
        self.cache: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def parts(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings lie between them."""
        if self.special is None or not self.special.search(text):
            return self.split(text), 0
        pieces = self.special.split(text)
        return [w for piece in pieces for w in self.split(piece)], len(pieces) - 1

    def encoded(self, word: str) -> int:
        return len(self.model.tokenize(word.encode().decode("latin-1").translate(self.letters)))

    def _learn(self, words: Iterable[str]) -> dict[str, int]:
        """Counts of words that the table lacks; the cache holds them afterwards, but for the very long ones."""
        if len(self.cache) > CACHE:
            self.cache, self.old = {}, self.cache
        cache, old, found = self.cache, self.old, {}
        for w in words:
            if (n := cache.get(w)) is None:
                n = old.get(w)
                n = self.encoded(w) if n is None else n
                if len(w) <= LONGEST:
                    cache[w] = n
            found[w] = n
        return found

    def count(self, texts: list[str]) -> list[int]:
        known, out = self.table.get, []
        for text in texts:
            words, special = self.parts(text)
            counts = list(map(known, words))
            if None in counts:
                missed = [w for w, n in zip(words, counts) if n is None]
                rest = self._learn(set(missed))
                special += sum(map(rest.__getitem__, missed)) + sum(n for n in counts if n is not None)
            else:
                special += sum(counts)
            out.append(special)
        return out


_loaded: dict[tuple, PreTokens] = {}


def counter(path: str, pattern: str, packed: Broadcast | None = None) -> PreTokens:
    """This worker's counter; a broadcast table replaces the one it had."""
    made = _loaded.setdefault((path, pattern), None) or PreTokens(path, pattern)
    _loaded[path, pattern] = made
    if packed is not None and getattr(made, "packed", None) != packed.value["id"]:
        words = packed.value["words"].split("\0") if packed.value["words"] else []
        made.table, made.packed = dict(zip(words, np.frombuffer(packed.value["counts"], "<u2").tolist())), packed.value["id"]
    return made


def frequent(docs: DataFrame, path: str, pattern: str, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, entries: int = ENTRIES) -> Broadcast:
    """The broadcast table: at most ``entries`` pre-tokens that are frequent in a sample of about ``sample_rows`` rows."""
    n = docs.count()
    texts = docs.select(quoted(text_col).alias("text"))
    texts = (texts.sample(min(1.0, sample_rows / n), 1) if n else texts).repartition(SKETCHES)

    def run(batches: Iterator[pa.RecordBatch]):
        pre, seen = counter(path, pattern), Counter()
        for _, some in blocks(batches, text_at=0, chars=BLOCK_CHARS):
            for text in some:
                seen.update(w for w in pre.parts(text)[0] if len(w) <= LONGEST and "\0" not in w)
            if len(seen) > 8 * entries:  # a sketch: rare ones go, as in lossy counting
                seen = Counter(dict(seen.most_common(4 * entries)))
        top = seen.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([k for _, k in top], pa.int64()), pa.array([pre.encoded(w) for w, _ in top], pa.int32())], ["word", "seen", "tokens"])

    found, tokens = Counter(), {}
    for word, seen, count in texts.mapInArrow(run, "word string, seen long, tokens int").collect():  # SKETCHES x entries rows at most
        found[word] += seen
        tokens[word] = count
    words = sorted(w for w, _ in found.most_common(entries))
    counts = np.array([tokens[w] for w in words], "<u2").tobytes()
    return docs.sparkSession.sparkContext.broadcast({"id": os.urandom(8), "words": "\0".join(words), "counts": counts})


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, entries: int = ENTRIES) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens)."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    packed = frequent(docs, path, pattern, text_col, sample_rows, entries)

    def run(batches: Iterator[pa.RecordBatch]):
        pre = counter(path, pattern, packed)
        for part, texts in blocks(batches, chars=BLOCK_CHARS):
            tokens = pa.array(pre.count(texts), pa.int64())
            size = pa.compute.binary_length(part.column(1)).cast(pa.int64()).fill_null(0)
            yield pa.RecordBatch.from_arrays([part.column(0), size, tokens, pa.compute.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
