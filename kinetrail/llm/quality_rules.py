"""Quality rules with host verdicts.

Each document gets counts over its whole text and a base verdict. Rule failures are then aggregated by host (the
``source`` column), each host's failure rate is shrunk with a beta prior fitted to all hosts' rates (method of
moments), and the verdict of the host joins back: documents of a host whose shrunk rate reaches ``max_host_rate``
go, even those that pass by themselves.

Everything is DataFrame functions. Counts of a text are made within its row, so no word is ever shuffled; only the
per-document counts (a few numbers a row) are written to the shared folder, aggregated with map-side combining and
joined. A hot host is one row of the small side of that join, and its documents are split by the adaptive skew join.

Defined results
* words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none, all counts are 0 and the base rule fails;
* a null host is a host of its own; repeated rows count each time; an empty table gives an empty result;
* if the hosts' rates have no spread (or there is one host), the prior has ``max_strength`` pseudo-documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.common import WS, fresh, quoted, stage

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.8
MAX_STRENGTH = 1000.0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SPACE = r"[ \t-\r]"


def _repeat_words(words: Column, n: int = 3) -> Column:
    """Words in n-word windows that the text holds twice or more. Windows are compared by a 64-bit hash.

    Texts without a repeated window (most) pay one hash set. The others sort (hash, place) pairs and look at
    neighbours, so the cost stays n log n in the text's length.
    """
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<bigint>"))


def document_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the five count columns (long) added; existing columns of these names give way."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    keep = [c for c in docs.columns if c not in COUNTS]
    t, words, grams, order = (fresh(docs, n) for n in ("kt_text", "kt_words", "kt_grams", "kt_order"))
    trimmed = F.btrim(text, F.lit(WS))
    df = docs.withColumn(t, text).withColumn(words, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPACE + "+")))
    df = df.withColumn(grams, _repeat_words(F.col(words)))
    # (hash, place) in order of hash, only where some hash comes twice
    df = df.withColumn(
        order,
        F.when(
            F.size(F.array_distinct(grams)) < F.size(grams),
            F.array_sort(F.transform(F.col(grams), lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    # a place repeats if the entry before or after it has the same hash
    pairs = F.zip_with(
        F.slice(order, 1, F.size(order) - 1),
        F.slice(order, 2, F.size(order) - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    places = F.array_distinct(F.flatten(F.transform(F.flatten(pairs), lambda i: F.array(i, i + 1, i + 2))))
    lines = F.filter(F.split(F.col(t), "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    distinct_lines = F.size(F.array_distinct(lines))
    counts = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - distinct_lines).cast("long").alias("n_dup_lines"),
        F.when(F.col(order).isNull(), F.lit(0)).otherwise(F.size(places)).cast("long").alias("n_repeat_words"),
    )
    # the generator keeps later filters above it: pushed below, they would repeat all of this within its own lambdas
    return df.select(*[quoted(c) for c in keep], F.inline(F.array(counts)))


def base_failed(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    return (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)


def host_rates(counts: DataFrame, host_col: str, max_strength: float = MAX_STRENGTH) -> DataFrame:
    """Per host: n_docs, n_failed, and host_rate, the failure rate shrunk with the hosts' empirical beta prior."""
    hosts = counts.groupBy(quoted(host_col).alias("host")).agg(F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed"))
    # each host's rate counts once; sampling noise m(1-m)/n is taken off the spread between hosts
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("n_docs")).alias("inv_n"))
    spread = F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("inv_n")
    strength = F.when(spread > 0, F.least(F.col("m") * (1 - F.col("m")) / spread - 1, F.lit(max_strength))).otherwise(F.lit(max_strength))
    prior = prior.select("m", F.greatest(strength, F.lit(1.0)).alias("strength"))
    # the prior is one row, an aggregate without keys
    return hosts.crossJoin(F.broadcast(prior)).select(
        "host", "n_docs", "n_failed", ((F.col("n_failed") + F.col("m") * F.col("strength")) / (F.col("n_docs") + F.col("strength"))).alias("host_rate")
    )


def quality_verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_host_rate: float = MAX_HOST_RATE,
) -> DataFrame:
    """Per document: doc_id, the five counts, base_failed, host_rate, kept."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(host_col).alias("host"), quoted(text_col).alias("text"))
    counts = document_counts(rows).drop("text").withColumn("base_failed", base_failed(min_words, max_repeat_percent))
    counts = stage(counts, "quality-counts")
    hosts = host_rates(counts, "host").select(F.col("host").alias("of_host"), "host_rate")
    joined = counts.join(hosts, counts["host"].eqNullSafe(hosts["of_host"]), "left")
    return joined.select("doc_id", *COUNTS, "base_failed", "host_rate", (~F.col("base_failed") & (F.col("host_rate") < max_host_rate)).alias("kept"))


def quality_filter(docs: DataFrame, text_col: str = "text", host_col: str = "source", max_host_rate: float = MAX_HOST_RATE, **rules) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns.

    Rows are marked once and written to the shared folder; hosts are counted from two columns of that table. Verdicts
    of bad hosts are a table of known size, which Spark broadcasts while it is small (``spark.sql.autoBroadcastJoinThreshold``);
    beyond that, rows join it by host and adaptive execution splits a hot one.
    """
    failed, of_host = (fresh(docs, n) for n in ("kt_failed", "kt_host"))
    marked = document_counts(docs.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]), f"c{docs.columns.index(text_col)}").withColumn("base_failed", base_failed(**rules))
    back = [quoted(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]
    marked = stage(marked.select(*back, F.col("base_failed").alias(failed)), "quality-marked")
    flags = marked.select(quoted(host_col).alias("host"), F.col(failed).alias("base_failed"))
    hosts = stage(host_rates(flags, "host").where(F.col("host_rate") >= max_host_rate).select(F.col("host").alias(of_host)), "bad-hosts")
    stay = marked.where(~F.col(failed))
    return stay.join(hosts, stay[host_col].eqNullSafe(hosts[of_host]), "left_anti").select(*[quoted(c) for c in docs.columns])
