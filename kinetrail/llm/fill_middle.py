"""Fill-in-middle transformation over an index of distinct texts.

The index has one row for each distinct text: SHA-256 verified by byte length and a 64-bit hash of other construction,
the number of its copies, and the byte offsets of its code-point boundaries as an Elias-Fano list. A task makes the list
of a text once, however many rows hold it; the aggregate over tasks keeps one. Documents are joined back to the index by
content and every row selects its two seeded cuts: a select on the list gives the byte offset of a code point without
decoding the text.

Texts move once, to meet their index rows. Rows of a text with many copies are dealt to as many slices as they need
(the index row goes to each); which texts those are is known from the index, at most ``HOT_KEYS`` of them by
construction, so that list is broadcast. Lists and texts of one task are streamed, a batch at a time.

Defined results
* null text counts as empty: plain, n = 0; a null id is seeded as the empty string; repeated rows are cut each, alike;
* texts that hold a sentinel stay plain, so an output can always be read back (``restore``);
* an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.common import quoted, small_batches, stage

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
KEY = ["sha", "size", "check"]
HOT_KEYS = 65_536
#: Rows of one text that stay together in a small table.
LEAST_SLICE = 64
#: One position of the high bits is kept for so many ones.
SAMPLE = 256


class EliasFano:
    """A rising list of numbers: ``low_bits`` low bits of each, packed, and the high parts in unary, with samples for select."""

    def __init__(self, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.low_bits, self.low, self.high = low_bits, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u8")

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        m, top = len(values), int(values[-1])
        bits = max(0, (top // m).bit_length() - 1)
        low = np.packbits(((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).reshape(-1), bitorder="little")
        ones = (values >> bits) + np.arange(m)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(bits, low.tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u8").tobytes())

    def __getitem__(self, i: int) -> int:
        block = i // SAMPLE
        first = int(self.samples[block]) // 8
        last = int(self.samples[block + 1]) // 8 + 1 if block + 1 < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[first:last], bitorder="little"))
        at = first * 8 + int(ones[i - block * SAMPLE + np.searchsorted(ones, int(self.samples[block]) - first * 8)])
        value = (at - i) << self.low_bits
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            value |= ((int(self.low[bit >> 3]) >> (bit & 7)) & 1) << k
        return value


def boundaries(text: bytes) -> np.ndarray:
    """Byte offsets of all code points of a UTF-8 text and of its end."""
    units = np.frombuffer(text, np.uint8)
    return np.append(np.flatnonzero((units & 0xC0) != 0x80), len(units))


def _content(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).alias("size"), F.xxhash64(text).alias("check")]


def text_index(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row a distinct text: sha, size, check, copies, n (code points) and its boundary list (low_bits, low, high, samples)."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    rows = docs.select(*_content(quoted(text_col)), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]):
        seen: dict[tuple, int] = {}  # content keys only; lists leave with the batch that first holds the text
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            out = []
            for i, key in enumerate(keys):
                if key not in seen:
                    ends = boundaries(batch.column(3)[i].as_py())
                    listed = EliasFano.of(ends)
                    out.append((*key, len(ends) - 1, listed.low_bits, listed.low.tobytes(), listed.high.tobytes(), listed.samples.tobytes()))
                seen[key] = seen.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*out)] or [()] * 8, kinds)] + [pa.array([0] * len(out), pa.int64())], names)
        copies = list(seen.values())
        for at in range(0, len(copies), 10_000):
            part = list(seen)[at : at + 10_000] if at else list(seen)[:10_000]
            none = [pa.nulls(len(part), t) for t in kinds[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)] + none + [pa.array(copies[at : at + 10_000], pa.int64())], names)

    kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = [*KEY, "n", "low_bits", "low", "high", "samples", "copies"]
    made = rows.mapInArrow(run, "sha binary, size int, check long, n long, low_bits int, low binary, high binary, samples binary, copies long")
    listed = F.first(F.when(F.col("n").isNotNull(), F.struct("n", "low_bits", "low", "high", "samples")), ignorenulls=True).alias("list")
    return made.groupBy(*KEY).agg(listed, F.sum("copies").alias("copies")).select(*KEY, "copies", "list.*")


def fill_middle(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars, output.

    The cuts and the form come from the SHA-256 of ``seed``, a colon and the id: its first four 8-digit groups choose the
    two cuts, whether a row is rearranged (all but ``plain_percent``) and whether the suffix goes first (``spm_percent``).
    """
    small_batches(docs.sparkSession)
    index = stage(text_index(docs, text_col), "text-index")
    total = index.agg(F.sum("copies")).first()[0] or 0
    most = max(LEAST_SLICE, -(-total // HOT_KEYS))  # so at most HOT_KEYS texts have more copies
    slices = F.ceil(F.col("copies") / most).cast("int")
    hot = index.where(F.col("copies") > most).select(*KEY, slices.alias("slices"))
    rows = docs.select(quoted(id_col).alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"), *_content(quoted(text_col)))
    rows = rows.join(F.broadcast(hot), KEY, "left")
    rows = rows.withColumn("slice", F.when(F.col("slices").isNull(), F.lit(0)).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("slices")).cast("int")))
    spread = index.withColumn("slice", F.explode(F.sequence(F.lit(0), F.when(F.col("copies") > most, slices).otherwise(F.lit(1)) - 1))).drop("copies")
    # the index side is the smaller one in every partition: no sort of the texts
    met = rows.join(spread.hint("shuffle_hash"), [*KEY, "slice"]).select("doc_id", F.col("text").cast("binary").alias("text"), "n", "low_bits", "low", "high", "samples")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for doc_id, text, n, *listed in zip(*(batch.column(k) for k in range(7))):
                text, n = text.as_py(), n.as_py()
                named = "" if not doc_id.is_valid else str(doc_id.as_py())
                h = hashlib.sha256(f"{seed}:{named}".encode()).hexdigest()
                h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
                if not n or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= 100 - plain_percent:
                    out.append((n, "plain", None, None, text))
                    continue
                a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                ends = EliasFano(*(x.as_py() for x in listed))
                x, y = ends[a], ends[b]
                prefix, middle, suffix = text[:x], text[x:y], text[y:]
                if h4 % 100 < spm_percent:
                    out.append((n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle))
                else:
                    out.append((n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            cols = [pa.array(c, t) for c, t in zip([*zip(*out)] or [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols[:4], cols[4].cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return met.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from; no text with a sentinel is rearranged, so the sentinels found are the added ones."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
