"""Line dedup: streamed first occurrences over range-partitioned line hashes.

Lines become (128-bit hash of the key, document, position); text is not shuffled for the search. Two rounds keep hot
lines apart:

1. hashes are range-partitioned together with a salt of the document, sorted within partitions by hash, salt,
   document and position, and the first document of each (hash, salt) streams over the rows behind it. Every row
   of another document is a repeat for good;
2. only the rows of these first documents meet again by hash alone (at most as many documents as salts), where the
   smallest document of all wins.

The number of salts is the square root of the number of lines, so that a line of every document puts about as many
rows into one task in either round, however many documents there are.

Dropped positions fold into 64-bit words by document; what comes back per document is a sparse keep bitmap: a map
from word number to keep bits that holds only words with a dropped line. Text meets the bitmaps once, at the end.

Defined results
* null or empty text: one empty line, nothing dropped; keys under ``min_chars`` code points never count;
* rows that repeat an id are the same document: they don't make a line repeated, and share the bitmap if their
  texts are equal; rows with a null id are told apart by their texts and come after all ids;
* an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinetrail.llm.common import WS, ascii_lower, quoted, stage

MIN_CHARS = 10
MIN_SALTS = 32


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, text_key, pos) of every line whose key has ``min_chars`` code points."""
    text = quoted(text_col)
    lines = docs.select(quoted(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.posexplode(_lines(text)).alias("pos", "line"))
    keys = lines.withColumn("line", F.btrim("line", F.lit(WS))).where(F.char_length("line") >= min_chars)
    keys = keys.withColumn("line", ascii_lower(F.col("line")))
    return keys.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), "doc_id", "text_key", "pos")


def _same_document(first_id: str, first_key: str) -> Column:
    same_id = F.col("doc_id").eqNullSafe(F.col(first_id))
    return same_id & (F.col("doc_id").isNotNull() | (F.col("text_key") == F.col(first_key)))


def _first(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first document of each key, streamed over the key's rows in order of document and position."""
    w = W.partitionBy(*keys).orderBy(F.col("doc_id").asc_nulls_last(), "text_key", "pos")
    return df.withColumns({"first_id": F.first("doc_id").over(w), "first_key": F.first("text_key").over(w)})


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, salts: int | None = None) -> DataFrame:
    """(doc_id, text_key, n_dropped, keep_words) of documents that lose a line; text_key is xxhash64 of the text."""
    hashes = stage(line_hashes(docs, id_col, text_col, min_chars), "line-hashes")
    salts = salts or max(MIN_SALTS, math.isqrt(hashes.count()))
    salted = hashes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(salts)))
    local = _first(salted.repartitionByRange("h1", "salt"), ["h1", "h2", "salt"])
    local = local.withColumn("repeat", ~_same_document("first_id", "first_key")).drop("first_id", "first_key")
    # repeats are settled: they keep to their salt; the rest of a hash meets in class -1
    met = _first(local.withColumn("salt", F.when(F.col("repeat"), F.col("salt")).otherwise(F.lit(-1))), ["h1", "h2", "salt"])
    dropped = met.where(F.col("repeat") | ~_same_document("first_id", "first_key"))
    words = dropped.groupBy("doc_id", "text_key", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(pos % 64))")).alias("bits"))
    return words.groupBy("doc_id", "text_key").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits")))).alias("keep_words"),
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, salts: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_lines, n_dropped, keep_words (null: all lines stay) and kept_text."""
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, salts)
    maps = maps.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), "n_dropped", "keep_words")
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    on = rows["doc_id"].eqNullSafe(maps["of_id"]) & (F.xxhash64(rows["text"]) == maps["of_key"])
    joined = rows.join(maps, on, "left")
    lines = _lines(F.col("text"))
    dense = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 64).cast("int")), lambda w: F.coalesce(F.try_element_at("keep_words", w), F.lit(-1).cast("long")))
    joined = joined.withColumn("dense", F.when(F.col("keep_words").isNotNull(), dense))
    kept = F.filter(lines, lambda x, i: F.get(F.col("dense"), F.floor(i / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(64)))) != 0)
    return joined.select(
        "doc_id",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        "keep_words",
        F.when(F.col("keep_words").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
    )
