"""Exact dedup: a tree merge of sorted digest runs.

Every input partition is a run: its digests, written in their order. In each round ``FAN_IN`` neighbouring runs meet in
one merged run, and for each digest the merge keeps the verified identifier that stays and the number of rows. A round is
a sort-based aggregate on digest and merged run: before the exchange each task combines what it has, behind it the runs'
rows are brought into digest order and equal neighbours are folded in one streaming pass, so no table of digests is held
in memory and every level leaves in digest order within its partitions. (Spark plans it so because the kept identifier
is a struct; a test holds the plan to it.) After about log(runs) rounds one run is left: the verdict of every digest. The
verdicts then go back down the same tree, so no join has a key with more rows than one run gives it: a text that a third
of all rows share is spread over all runs.

A digest is SHA-256 verified by the byte length and a 64-bit hash of other construction, so two different texts never
share a group in practice.

Defined results
* null text counts as empty; empty texts are equal to each other and form one group;
* repeated rows (same id, same text): exactly one of them is kept, ``group_size`` counts all rows;
* a null id loses against any id; if all ids of a group are null, one row stays and ``keep_id`` is null;
* an empty table gives an empty result; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.common import fresh, quoted, stage, tidied

FAN_IN = 8
KEY = ["sha", "size", "check"]


def _digest(text):
    text = F.coalesce(text, F.lit(""))
    return [F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).alias("size"), F.xxhash64(text).alias("check")]


def merge_level(below: DataFrame, fan_in: int, best) -> DataFrame:
    """One round: ``fan_in`` runs each of (digest, run, best, n) become one."""
    merged = F.floor(F.col("run") / fan_in).cast("int").alias("run")
    return below.groupBy(*KEY, merged).agg(best("best").alias("best"), F.sum("n").alias("n"))


def digest_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = FAN_IN, carry: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, and the digest (sha, size, check).

    ``keep``: "max" keeps a group's largest id, "min" its smallest. ``carry``: a column of ``docs`` to return as ``carried``.
    """
    if keep not in ("max", "min") or fan_in < 2:
        raise ValueError("keep is 'max' or 'min'; fan_in is at least 2")
    best = {"max": F.max, "min": F.min}[keep]
    last = F.lit(-1 if keep == "max" else 1)
    more = [quoted(carry).alias("carried")] if carry else []
    rows = docs.select(quoted(id_col).alias("doc_id"), *_digest(quoted(text_col)), *more)
    rows = stage(
        rows.withColumns({"run": F.spark_partition_id(), "row": F.monotonically_increasing_id()}).sortWithinPartitions(*KEY, "doc_id"),
        "digest-runs",
    )
    # nulls lose: the first field of the compared struct says whether there is an id
    ident = F.struct(F.when(F.col("doc_id").isNull(), last).otherwise(F.lit(0)).alias("none"), F.col("doc_id").alias("id"), F.col("row"))
    levels = [rows.groupBy(*KEY, "run").agg(best(ident).alias("best"), F.count("*").alias("n"))]
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    while runs > 1:
        levels.append(merge_level(levels[-1], fan_in, best))
        runs = -(-runs // fan_in)
    verdict = levels.pop()
    while levels:  # down again: a digest has at most fan_in rows for each one above
        below = levels.pop().select(*KEY, F.col("run").alias("below"), F.floor(F.col("run") / fan_in).cast("int").alias("run"))
        verdict = below.join(verdict, [*KEY, "run"]).select(*KEY, F.col("below").alias("run"), "best", "n")
    return rows.join(verdict, [*KEY, "run"]).select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        *KEY,
        *(["carried"] if carry else []),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; one row of every group of equal texts.

    Rows get a key of their own, so texts meet the verdicts once, in one join on that key (none where Spark can
    broadcast the dropped rows' keys).
    """
    key = fresh(docs, "kt_row")
    rows = stage(docs.withColumn(key, F.monotonically_increasing_id()), "exact-dedup-rows")
    with tidied() as kept:
        gone = kept(stage(digest_groups(rows, id_col, text_col, keep, carry=key).where("not kept").select(F.col("carried").alias(key)), "exact-copies"))
    return rows.join(gone, key, "left_anti").select(*[quoted(c) for c in docs.columns])
