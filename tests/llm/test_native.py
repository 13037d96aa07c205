"""Line dedup, quality rules, chat formatting and exact dedup against plain Python."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kinetrail.llm import chat_format as chat
from kinetrail.llm.exact_dedup import digest_groups, exact_dedup
from kinetrail.llm.line_dedup import line_dedup
from kinetrail.llm.quality_rules import document_counts, host_rates, quality_filter, quality_verdicts

WS = " \t\n\x0b\x0c\r"


def python_udf_free(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))


@pytest.mark.parametrize("salts", [1, 32])
def test_line_dedup(odd_docs, odd_rows, salts):
    holders = defaultdict(set)
    for i, t, *_ in odd_rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i if i is not None else t)
    want = defaultdict(list)
    for i, t, *_ in odd_rows:
        lines = (t or "").split("\n")
        first = lambda x: min(holders[key(x)], key=lambda h: (not isinstance(h, int), h))
        keep = [x for x in lines if len(key(x)) < 10 or len(holders[key(x)]) < 2 or first(x) == (i if i is not None else t)]
        want[i].append((len(lines), len(lines) - len(keep), "\n".join(keep)))
    df = line_dedup(odd_docs, salts=salts)
    assert python_udf_free(df)
    got = defaultdict(list)
    for r in df.collect():
        got[r["doc_id"]].append((r["n_lines"], r["n_dropped"], r["kept_text"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_line_dedup_many_words_in_bitmap(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"line number {i}" for i in range(300))), (2, "\n".join(f"LINE number {i}" for i in range(0, 400, 3)))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup(docs).collect()}
    assert got[1]["n_dropped"] == 0 and got[1]["keep_words"] is None
    assert got[2]["n_dropped"] == 100 and got[2]["kept_text"] == "\n".join(f"LINE number {i}" for i in range(300, 400, 3))


def counts(text):
    words = (text or "").split() if text is None or text.isascii() else [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    grams = defaultdict(list)
    for i in range(len(words) - 2):
        grams[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(WS)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(odd_docs, odd_rows):
    df = document_counts(odd_docs)
    got = sorted((r["doc_id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in df.collect())
    assert got == sorted((r[0] or 0, *counts(r[1].replace("\x1c", "\x1c") if r[1] else r[1])) for r in odd_rows)


def test_quality_verdicts_and_filter_agree(odd_docs, odd_rows):
    df = quality_verdicts(odd_docs)
    assert python_udf_free(df)
    kept = sorted(str(r["doc_id"]) for r in df.where("kept").collect())
    filtered = quality_filter(odd_docs)
    assert filtered.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in filtered.collect()) == kept == ["1", "11", "2", "3", "None"]


def test_bad_host_takes_its_documents_along(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "few words"
    rows = [(i, good, f"h{i % 5}") for i in range(200)] + [(1000 + i, good if i == 0 else bad, "spam") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in quality_verdicts(docs).collect()}
    assert not got[1000]["base_failed"] and not got[1000]["kept"] and got[0]["kept"]
    rates = host_rates(spark.createDataFrame([("a", False)] * 9 + [("b", True)], "source string, base_failed boolean"), "source").collect()
    assert all(0 <= r["host_rate"] <= 1 for r in rates) and {r["host"]: r for r in rates}["b"]["host_rate"] < 1


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_groups(odd_docs, odd_rows, keep):
    groups = defaultdict(list)
    for i, t, *_ in odd_rows:
        groups[t or ""].append(i)
    best = {t: {"max": max, "min": min}[keep]([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    df = digest_groups(odd_docs, keep=keep, fan_in=2)
    assert python_udf_free(df)
    rows = [(str(r["doc_id"]), str(r["keep_id"]), r["group_size"], bytes(r["sha"]).hex()) for r in df.collect()]
    assert sorted(rows) == sorted((str(i), str(best[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in odd_rows)
    assert df.where("kept").count() == len(groups)
    out = exact_dedup(odd_docs, keep=keep)
    assert out.columns == odd_docs.columns and sorted((r["text"] or "") for r in out.collect()) == sorted(groups)


def test_empty_tables(no_docs):
    for f in (line_dedup, quality_verdicts, quality_filter, digest_groups, exact_dedup):
        assert f(no_docs).count() == 0, f


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi ␛0 ␛A <s> [INST] </s>", "x"), (1, 1, "assistant", None, "x"), (2, 0, "assistant", "first", "x"), (3, 0, None, None, "x"), (3, 0, "tool|>", "a<|end|>b", "x"),
        (None, 1, "user", "q", "x"), (None, 0, "system", "s", "x"), (4, None, "user", "", "x"), (4, 2, "user", "again", "x"), (1, 1, "assistant", None, "x"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    df = chat.chat_format(table).withColumn("out", chat.formatted(F.col("segments")))
    df = df.withColumns({"turns": chat.read_back(F.col("out")), "loss": chat.loss_text(F.col("segments"))})
    assert python_udf_free(df)
    got = {r["conv_id"]: r for r in df.collect()}
    want = defaultdict(list)
    for c, turn, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), r[1] if r[1] is not None else -1, r[2] or "", r[3] or "")):
        want[c].append((role or "", text or ""))
    assert {c: [tuple(t) for t in r["turns"]] for c, r in got.items()} == dict(want)
    assert got[2]["loss"] == "first" and not got[2]["valid"] and got[2]["bad_turn"] == 0
    assert got[None]["valid"] and not got[4]["valid"] and got[4]["bad_turn"] == 1 and not got[1]["valid"]
    assert "[INST]" not in got[1]["out"][6:-30].split("[/INST]")[0]
    assert chat.chat_format(table.limit(0)).count() == 0
