"""Fill-in-middle, token counts and periodic runs against plain Python."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinetrail.llm import fill_middle as M
from kinetrail.llm import periodic_runs as R
from kinetrail.llm import token_counts as T
from kinetrail.llm.queries import QUERIES, planted_period

WHITE = " \t\n\x0b\x0c\r"


def words_of(text: str) -> list[str]:
    return "".join(" " if c in WHITE else c for c in text).split(" ") if text else []


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def key(row):
    return tuple((x is None, str(x)) for x in row)


def fill_plain(doc_id, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not n or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}")
    return (doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


def runs_plain(words, min_length=24, min_exponent=3):
    """Every stretch that keeps a period, for all periods; only the smallest of a stretch counts."""
    found, n = {}, len(words)
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_length, min_exponent * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((i, j - i, q) for (i, j), q in found.items())


@pytest.mark.parametrize("values", [[0], [0, 1, 2, 3], [0, 3, 7, 7, 1000], list(range(0, 4000, 3)), [0] * 700 + [9000]])
def test_elias_fano_selects_every_value(values):
    listed = M.EliasFano.of(np.array(values))
    again = M.EliasFano(listed.low_bits, listed.low.tobytes(), listed.high.tobytes(), listed.samples.tobytes())
    assert [again[i] for i in range(len(values))] == values


def test_boundaries_of_wide_characters():
    text = "aé中😀" * 500
    listed = M.EliasFano.of(M.boundaries(text.encode()))
    assert all(text.encode()[: listed[i]].decode() == text[:i] for i in range(0, len(text) + 1, 37))


def test_fill_middle_equals_plain_python(spark, odd_docs, odd_rows, no_docs):
    more = [(100 + i, s, None, None, None) for i, s in enumerate(["<P>", "a<S>b", "<", "<P", ">", "S>x<", "<M", "中文" * 300, "é", "😀"] * 6)]
    rows = odd_rows + more
    extra = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd_docs.unionByName(extra, allowMissingColumns=True)
    found = M.fill_middle(docs)
    got = sorted((tuple(r) for r in found.collect()), key=key)
    assert got == sorted((fill_plain(r[0], r[1]) for r in rows), key=key)
    back = found.select("doc_id", M.restore(F.col("output"), F.col("form")).alias("t"))
    assert sorted((tuple(r) for r in back.collect()), key=key) == sorted(((r[0], r[1] or "") for r in rows), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert M.fill_middle(no_docs).collect() == [] and M.fill_middle(no_docs).columns == found.columns


def test_one_text_of_many_rows_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(M, "LEAST_SLICE", 8)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "shared täxt of many").otherwise(F.concat(F.lit("own "), "id")).alias("text")).repartition(7)
    index = M.text_index(docs)
    assert index.count() == 201 and index.agg(F.max("copies"), F.sum("copies")).first()[:] == (100, 300)
    got = sorted(tuple(r) for r in M.fill_middle(docs).collect())
    assert got == sorted(fill_plain(i, "shared täxt of many" if i % 3 == 0 else f"own {i}") for i in range(300))


def test_token_counts_equal_the_library(spark, odd_docs, odd_rows, no_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    strange = ["<|endoftext|>", "a <|endoftext|>  <|endoftext|>b\n\n", "<|endoftext", "  a  \n\t b's 'S 12x½ Ⅷ", "\x00a\x00\x00", " \x85  x　　y", "ﬁ ñ ñ", "the " * 2000, "1" * 5000, "\x1c \x1f"]
    rows = [(r[0], r[1]) for r in odd_rows] + [(200 + i, s) for i, s in enumerate(strange)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = []
    for i, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 512))
    for sample, entries in ((4000, 32_768), (4000, 5), (1, 0)):  # whatever the table holds
        got = T.token_counts(docs, path, public_tokenizers.PATTERN, sample_rows=sample, entries=entries)
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    got = T.token_counts(odd_docs, path, public_tokenizers.PATTERN).collect()
    assert sorted((tuple(r) for r in got), key=key) == sorted(want[: len(odd_rows)], key=key)
    assert T.token_counts(no_docs, path, public_tokenizers.PATTERN).collect() == []


def test_token_counts_forget_and_learn_again(monkeypatch):
    monkeypatch.setattr(T, "CACHE", 3)
    pre = T.PreTokens(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    texts = [f"some word{i} again {'long' * 40}" for i in range(30)]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert pre.count(texts + texts) == [len(library.encode(t).ids) for t in texts + texts]
    assert len(pre.cache) < 20 and not any(len(w) > T.LONGEST for w in pre.cache)


@pytest.mark.parametrize("bounds", [(2, 2), (4, 2), (6, 3), (24, 3), (5, 4)])
def test_runs_equal_brute_force(bounds):
    r = random.Random(7)
    for _ in range(60):
        docs = []
        for _ in range(r.randint(1, 6)):
            k, n = r.choice([1, 2, 2, 3, 5]), r.choice([0, 1, 5, 30, 90])
            words = [r.randrange(k) for _ in range(n)]
            for _ in range(r.randint(0, 4)):  # plant periods and copies of stretches
                n = len(words)
                if n > 4:
                    a, p = r.randrange(n), r.randint(1, 9)
                    b = min(n, a + r.randint(1, 60))
                    for i in range(a + p, b):
                        words[i] = words[i - p]
                    a, b, ln = r.randrange(n), r.randrange(n), r.randint(1, 40)
                    words[b : b + ln] = words[a : a + ln]
                    words = words[:n]
            docs.append(words)
        starts = np.append(0, np.cumsum([len(d) for d in docs]))
        flat = np.array([w for d in docs for w in d], np.int64)
        got = list(zip(*(x.tolist() for x in R.find_runs(flat, starts, *bounds))))
        assert got == [(i, *x) for i, d in enumerate(docs) for x in runs_plain(d, *bounds)]


def test_runs_in_small_slices_of_pairs(monkeypatch):
    monkeypatch.setattr(R, "PAIRS", 7)
    words = ([1, 2, 3] * 20 + [4] * 30 + [1, 2, 3] * 20 + [9]) * 2
    got = R.find_runs(np.array(words), np.array([0, len(words)]))
    assert [tuple(x) for x in zip(*(y.tolist() for y in got[1:]))] == runs_plain(words)


def test_words_of_a_slice():
    texts = pa.array(["skipped", "", " a  bé\tc", "d", "\n", "e\x1cf 中　g"]).slice(1)
    words, starts = R.split_words(texts)
    assert words.to_pylist() == ["a", "bé", "c", "d", "e\x1cf", "中　g"] and starts.tolist() == [0, 0, 3, 4, 4, 6]


def plain_periodic(doc_id, text, plant):
    words = [w for w in words_of(text or "") if w]
    n = len(words)
    if plant and (plan := planted_period(doc_id, n)) is not None:
        a, p = plan
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_plain(words)
    gone = {i for s, ln, q in runs for i in range(s + q, s + ln)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *told, sha("".join(f"{s},{ln},{q}\n" for s, ln, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_periodic_runs_of_odd_documents(spark, odd_docs, odd_rows, no_docs):
    got = R.periodic_runs(odd_docs).collect()
    for r in got:
        assert r["n_words"] == len([w for w in words_of(next((x[1] for x in odd_rows if x[0] == r["doc_id"] and x[0] is not None), None) or "") if w]) or r["doc_id"] is None
    assert len(got) == len(odd_rows) and all(r["runs"] == [] for r in got)
    assert R.periodic_runs(no_docs).collect() == []


def test_new_queries_against_plain_python(spark, tmp_path):
    """The registered queries on texts with planted and own periods."""
    r = random.Random(3)
    rows = []
    for i in range(120):
        words = [r.choice("one two three four five six seven".split()) if r.random() < 0.3 else f"w{r.randrange(400)}" for _ in range(r.choice([0, 3, 40, 90, 160]))]
        if i % 4 == 0 and words:
            words += (words[-3:] * 15)[: r.randint(20, 45)] + ["stop"] + words[-50:]
        rows.append((i, " ".join(words) if i % 17 else None, "en", "s", 1))
    folder = tmp_path / "documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(folder))
    got = sorted(tuple(x) for x in QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect())
    assert got == sorted(plain_periodic(i, text, True) for i, text, *_ in rows)
    assert sum(x[1] > 0 for x in got) > 20 and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(120)) > 5
    got = sorted(tuple(x) for x in QUERIES["op11_fill_middle"](spark, str(tmp_path)).collect())
    want = [(*fill_plain(i, text)[:5], sha(fill_plain(i, text)[5]), sha(text or "")) for i, text, *_ in rows]
    assert [key(x) for x in got] == [key(x) for x in sorted(want)]


# --- what changed in earlier operators ---


def test_digest_levels_are_sorted_merges(spark):
    """Each round of the tree is a sort-based aggregate, and leaves in digest order within its partitions."""
    from kinetrail.llm import exact_dedup as E

    rows = spark.range(4000).select((F.col("id") % 700).cast("string").cast("binary").alias("sha"), F.lit(1).alias("size"), F.lit(1).cast("long").alias("check"), F.pmod("id", F.lit(16)).cast("int").alias("run"), "id")
    base = rows.groupBy(*E.KEY, "run").agg(F.max(F.struct(F.lit(0).alias("none"), "id", F.col("id").alias("row"))).alias("best"), F.count("*").alias("n"))
    level = E.merge_level(base, 8, F.max)
    plan = level._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "HashAggregate" not in plan
    got = level.withColumn("p", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).collect()
    assert sum(r["n"] for r in got) == 4000 and {r["run"] for r in got} == {0, 1}
    for p in {r["p"] for r in got}:
        mine = [bytes(r["sha"]) for r in sorted((r for r in got if r["p"] == p), key=lambda r: r["at"])]
        assert mine == sorted(mine)


def test_tables_of_a_block_are_deleted(spark):
    import os

    from kinetrail.llm.common import stage, tidied

    with tidied() as outer:
        with tidied() as inner:
            a, b = stage(spark.range(3), "a"), inner(stage(spark.range(4), "b"))
        c = outer(stage(spark.range(5), "c"))
        at = lambda df: df.staged_at.removeprefix("file://")
        assert not os.path.exists(at(a)) and b.count() == 4
    assert not os.path.exists(at(b)) and c.count() == 5


def test_toxicity_sample_is_bounded_by_ids(spark):
    """Rows that share a sampled id are one in the fit, however many there are."""
    from kinetrail.llm import toxicity

    r = random.Random(1)
    mild = "the weather stays calm and the river flows past old stones near town".split()
    rows = [(i, " ".join(r.choices(mild, k=12) + (["vilething", "grotword"] if i % 3 == 0 else []))) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = toxicity.train(docs, labels)
    hot = docs.union(docs.where("doc_id = 5").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(400)))).drop("k"))
    many = toxicity.train(hot, labels)
    assert np.allclose(once.weights, toxicity.train(docs.repartition(7), labels).weights) and len(many.weights) == len(once.weights)
    scores = {x["doc_id"]: x["score"] for x in toxicity.score(docs, many).collect()}
    assert min(scores[i] for i in range(0, 120, 3)) > max(scores[i] for i in range(120) if i % 3)


def test_pipeline_stages_on_odd_documents(spark, odd_docs, odd_rows):
    """Near dedup and exact dedup on nulls, blanks and repeated rows; every stage runs on them."""
    import corpus_pipeline as cp

    names = dict(cp.STAGES)
    ids = lambda df: sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in df.collect())
    near = ids(names["near dedup"](spark, odd_docs, ""))
    assert near == sorted([(False, i) for i in (1, 4, 7, 8, 9, 11, 12, 13)] + [(False, 10)] * (10 in {i for _, i in near}) + [(True, 0)] * 2)
    exact = ids(names["exact dedup"](spark, odd_docs, ""))
    assert exact == sorted([(False, i) for i in (2, 3, 5, 6, 7, 8, 9, 10, 11, 12, 13)] + [(True, 0)])
    docs = odd_docs
    for name, step in cp.STAGES:
        docs = cp.stage(step(spark, docs, ""), "odd")
        assert name == "packing" or docs.columns == odd_docs.columns
    assert cp.stage(names["packing"](spark, odd_docs, ""), "odd").count() >= len(odd_rows)


def test_packing_with_a_small_memory_gives_the_same_pieces(spark, odd_docs):
    from kinetrail.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = lambda **how: sorted(map(str, pack(odd_docs, path, **how).collect()))
    assert rows() == rows(remembered=0.001)


def test_a_worker_holds_one_operators_memory():
    from kinetrail.llm.common import held

    made = []
    make = lambda path: made.append(path) or [path]
    first = held("a", "p", make)
    assert held("a", "p", make) is first and held("b", "p", make) == ["p"] and held("a", "p", make) is not first
    assert made == ["p"] * 3
