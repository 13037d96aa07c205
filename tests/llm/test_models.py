"""SimHash, near-dedup, language ID, licences, toxicity and the pipeline against brute force or held-out rows."""

import random
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from kinetrail.llm import language_id, license_scan, simhash, toxicity
from kinetrail.llm.components import connected_components

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def plain_fingerprint(text, n):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", words)]
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("tile", [2, 2048])
def test_links_lose_nothing(spark, tile):
    r = random.Random(9)
    fps = {r.getrandbits(64) for _ in range(60)}
    for f in list(fps)[:20]:
        for _ in range(4):
            g = f
            for b in r.sample(range(64), r.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    pairs = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = connected_components(simhash.links(df, tile=tile)).collect()
    want = {n: x for n, x in components(signed, pairs).items() if any(n in p for p in pairs)}
    assert {r["node"]: r["root"] for r in roots} == want


def test_near_groups(odd_docs, odd_rows, no_docs):
    got = simhash.near_groups(odd_docs).collect()
    fps = [plain_fingerprint(r[1], 3) for r in odd_rows]
    assert sorted((str(r["doc_id"]), r["fp"] & ((1 << 64) - 1)) for r in got) == sorted((str(r[0]), f) for r, f in zip(odd_rows, fps))
    pairs = [(i, j) for i, j in combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    roots = components(range(len(fps)), pairs)
    least = {}
    for i, r in enumerate(odd_rows):
        least.setdefault(roots[i], []).append(r[0])
    want = sorted((str(r[0]), str(min((x for x in least[roots[i]] if x is not None), default=None))) for i, r in enumerate(odd_rows))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == want
    assert simhash.near_groups(no_docs).count() == 0


def test_chain_of_links(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    df = spark.createDataFrame(chain, "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_near_dedup(spark, odd_docs, no_docs):
    r = random.Random(4)
    rows, near = [], []
    for i in range(40):
        words = [f"w{r.randint(0, 9999)}" for _ in range(200)]
        rows.append((i * 10, " ".join(words)))
        for k in range(1, 3):  # two words changed: about 190 of 200 windows stay
            copy = list(words)
            for at in r.sample(range(200), 2):
                copy[at] = f"new{r.randint(0, 9999)}"
            rows.append((i * 10 + k, " ".join(copy)))
            near.append(i * 10 + k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {x["doc_id"] for x in simhash.near_dedup(docs).collect()}
    assert kept == {i * 10 for i in range(40)}
    assert {x["doc_id"] for x in simhash.near_dedup(docs, tile=8).collect()} == kept
    out = simhash.near_dedup(odd_docs)
    assert out.columns == odd_docs.columns
    ids = [x["doc_id"] for x in out.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(None) == 2
    assert simhash.near_dedup(no_docs).count() == 0


def shingle_sets(texts, n=5):
    return [{" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (t.split() for t in texts)]


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(r, words, runs, longest=4):
    """``words`` with ``runs`` stretches changed."""
    out = list(words)
    for _ in range(runs):
        at = r.randrange(len(out))
        for k in range(at, min(len(out), at + r.randint(1, longest))):
            out[k] = f"new{r.randint(0, 99999)}"
    return out


def test_near_dedup_is_exact_jaccard(spark):
    r, rows, sims = random.Random(11), [], []
    while len(sims) < 300:  # pairs at 0.74 to 0.85
        words = [f"w{r.randint(0, 99999)}" for _ in range(300)]
        texts = [" ".join(words), " ".join(edited(r, words, r.randint(3, 8)))]
        if 0.74 <= (sim := jaccard(*shingle_sets(texts))) <= 0.85:
            rows += [(2 * len(sims) + k, t) for k, t in enumerate(texts)]
            sims.append(sim)
    kept = {x["doc_id"] for x in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = [2 * i + 1 not in kept for i in range(len(sims))]
    wrong = [s for s, g in zip(sims, gone) if g and s < 0.8]
    caught = [g for s, g in zip(sims, gone) if s >= 0.8]
    print(f"recall {np.mean(caught):.3f} of {len(caught)}, wrongly dropped {len(wrong)} of {len(sims) - len(caught)}")
    assert not wrong and np.mean(caught) >= 0.98 and len(caught) > 100


def test_near_dedup_goes_by_row(spark):
    r = random.Random(15)
    a, b, c = ([f"w{r.randint(0, 99999)}" for _ in range(200)] for _ in range(3))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (2, near(a)), (2, " ".join(b)), (3, " ".join(c)), (3, near(c)), (4, " ".join(c))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((x["doc_id"], x["text"]) for x in simhash.near_dedup(docs).collect())
    assert [x[0] for x in kept] == [1, 2, 3] and kept[1][1] == " ".join(b) and kept[2] in rows[3:5]


@pytest.mark.parametrize("how", [{}, {"family_tile": 1}])
def test_dense_family_equals_brute_force(spark, how):
    r = random.Random(12)
    words = [f"w{r.randint(0, 99999)}" for _ in range(200)]
    texts = [" ".join(edited(r, words, r.randint(1, 4))) for _ in range(120)]
    sets = shingle_sets(texts)
    pairs = [(i, j) for i, j in combinations(range(120), 2) if jaccard(sets[i], sets[j]) >= 0.8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {x["doc_id"] for x in simhash.near_dedup(docs, **how).collect()}
    want = set(components(range(120), pairs).values())
    print(f"kept {len(kept)}, brute force {len(want)}, of both {len(kept & want)}")
    assert kept == want and 5 < len(want) < 115


def test_verdict_is_the_same_at_every_size(spark, monkeypatch):
    r, rows, low, plan = random.Random(13), [], set(), simhash.plan
    while len(rows) < 240:
        words = [f"w{r.randint(0, 99999)}" for _ in range(300)]
        texts = [" ".join(words), " ".join(edited(r, words, r.randint(1, 7)))]
        sim = jaccard(*shingle_sets(texts))
        if 0.76 <= sim < 0.8 or 0.85 <= sim:
            low |= {len(rows) + 1} if sim < 0.8 else set()
            rows += [(len(rows) + k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = []
    for size in (240, 50_000_000):
        monkeypatch.setattr(simhash, "plan", lambda n, *how, size=size: plan(size, *how))
        kept.append({x["doc_id"] for x in simhash.near_dedup(docs).collect()})
    assert kept[0] == kept[1] == {i for i in range(240) if i % 2 == 0 or i in low} and 20 < len(low) < 100


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_forward_sums_all_segmentations():
    pieces = language_id._load(PIECES)
    table = np.random.default_rng(0).random((pieces.n + 2, 2)) / 1000
    table[-1] = 0
    word = "▁tion"
    chars = np.array([[ord(c) for c in word]], np.uint64)
    spans = {k: int(v[0]) for k, v in pieces.spans(chars).items() if v[0] <= pieces.n}

    def total(i):
        return np.ones(2) if i == len(word) else sum((table[p] * total(b) for (a, b), p in spans.items() if a == i), np.zeros(2))

    assert np.allclose(language_id.log_likelihoods([word], pieces, table)[0], np.log(total(0)))
    counts = language_id.expected_counts([word], np.array([0]), np.array([3]), pieces, table)
    sizes = {p: b - a for (a, b), p in spans.items()}
    assert np.isclose(sum(counts[p, 0] * n for p, n in sizes.items()), 3 * len(word))


def test_long_words_are_scored_whole(monkeypatch):
    pieces = language_id._load(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    table = language_id._normalised(rng.random((pieces.n + 2, 3)))
    words = ["▁" + "".join(rng.choice(list("abcdeinorst是不的"), n)) for n in (5, 26, 27, 27, 31, 40)]
    langs, counts = np.array([0, 1, 2, 0, 1, 2]), np.arange(1.0, 7)
    scores, uses = language_id.log_likelihoods(words, pieces, table), language_id.expected_counts(words, langs, counts, pieces, table)
    monkeypatch.setattr(language_id, "LONGEST", 1000)  # the plain pass, which can't underflow at these lengths
    np.testing.assert_allclose(scores, language_id.log_likelihoods(words, pieces, table))
    np.testing.assert_allclose(uses, language_id.expected_counts(words, langs, counts, pieces, table), atol=1e-9)
    monkeypatch.undo()
    assert np.isfinite(language_id.log_likelihoods(["▁" + "ab" * 2000], pieces, table)).all()
    scorer = language_id.Scorer(pieces, table)
    once = scorer.score(["abc " + "xyz" * 40, "abc", "1"])
    assert list(scorer.row) == ["abc"] and len(scorer.vectors) == 1 and once[2] is None
    np.testing.assert_allclose(once[:2], scorer.score(["abc " + "xyz" * 40, "abc"]))


def test_too_many_languages_fail(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_TABLE_BYTES", 1)
    with pytest.raises(ValueError, match="lang"):
        language_id.train(spark.createDataFrame([(1, "some text", "en")], "doc_id long, text string, lang string"), public_tokenizers.path("piece_bpe_32k.model"))


def test_language_training_counts_every_text(spark):
    """4,200 texts of a language teach the same as one text that holds all their words."""
    words = ["house", "river", "garden", "window", "letter", "winter", "people"]
    texts = [" ".join(words[(i * k) % 7] for k in (1, 2, 4)) + " rare" * (i % 60 == 0) for i in range(4200)]
    every = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    whole = spark.createDataFrame([(1, " ".join(texts), "en")], "doc_id long, text string, lang string")
    got, expected = (language_id.train(d, PIECES, judge_fit=False).table for d in (every, whole))
    assert np.allclose(got, expected, rtol=1e-9, atol=1e-15)


def test_language_held_out(spark, sample, odd_docs, no_docs):
    model = language_id.train(sample, PIECES, held_out=language_id.held_out_quarter())
    got = language_id.predict(sample, model).join(sample.select("doc_id", "lang"), "doc_id").where(language_id.held_out_quarter()).collect()
    assert len(got) > 20 and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r for r in language_id.predict(odd_docs, model).collect()}
    assert len(odd) == 14 and odd[4]["lang_pred"] == odd[5]["lang_pred"] == odd[6]["lang_pred"] == "und" and odd[7]["lang_pred"] in model.languages
    kept = language_id.language_filter(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.where("doc_id in (4, 5, 6)").count() == 0
    assert language_id.predict(no_docs, model).count() == 0 and language_id.train(no_docs, PIECES).languages == []
    assert {r["lang_pred"] for r in language_id.predict(sample.limit(5), language_id.train(no_docs, PIECES)).collect()} == {"und"}


def test_language_filter_rejects_what_was_never_learned(spark):
    r = random.Random(14)
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and size(split(text, ' ')) between 60 and 400")
    model = language_id.train(docs.where("lang <> 'fr'"), PIECES)
    odd = [(-i, " ".join("".join(r.choice(letters) for _ in range(r.randint(*size))) for _ in range(80))) for i, size in enumerate([(2, 9)] * 5 + [(1, 1)] * 5, 1)]
    rows = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "'none'"))
    share = {x["lang"]: x["share"] for x in rows.join(language_id.language_filter(rows, model).selectExpr("doc_id as kept"), rows["doc_id"] == F.col("kept"), "left").groupBy("lang").agg(F.avg(F.col("kept").isNotNull().cast("int")).alias("share")).collect()}
    print(f"kept {share}")
    assert share["fr"] < 0.02 and share["none"] == 0 and min(share[x] for x in ("de", "en", "es")) > 0.99


def test_license_expressions():
    assert license_scan.postfix("MIT OR Apache-2.0 AND (GPL-2.0-only WITH Classpath-exception-2.0)") == ["MIT", "Apache-2.0", "GPL-2.0-only", "Classpath-exception-2.0", "with", "and", "or"]
    assert license_scan.evaluate("MIT OR GPL-3.0-only") == ({"mit", "gpl"}, 1.0)
    assert license_scan.evaluate("MIT AND GPL-3.0-only") == ({"mit", "gpl"}, 0.4)
    labels, grade = license_scan.evaluate("GPL-2.0-only WITH Classpath-exception-2.0")
    assert labels == {"gpl"} and abs(grade - 0.6) < 1e-9
    assert license_scan.postfix("(MIT") is None and license_scan.postfix("OR MIT") is None and license_scan.postfix("") is None
    assert license_scan.evaluate("Nothing-1.0") == (set(), license_scan.UNKNOWN)


def test_license_tags_are_read_whole():
    m = license_scan.automaton()
    scan = lambda text: license_scan.scan(text, m)[5:]
    assert scan("SPDX License Identifier: Apache-2.0") == ("apache", 0.95)
    assert scan("// SPDX-License-Identifier: (MIT OR\n// GPL-3.0-only) AND AGPL-3.0-only\nISC") == ("agpl,gpl,mit", 0.3)
    assert scan("SPDX-License-Identifier: MIT\nOR GPL-2.0-only") == ("mit", 1.0)  # no parenthesis is open at the line's end
    assert scan("SPDX-License-Identifier: (MIT\nmore text") == ("mit", 1.0)
    assert scan("GNU Lesser General Public License") == ("gpl,lgpl", 0.6)


def test_license_scan(spark, odd_docs, no_docs):
    m = license_scan.automaton()
    assert license_scan.scan("MIT-License mit\nlicense; the General  Public License", m)[:5] == (8, 3, 0, 5, "gpl,mit")
    assert license_scan.scan("permit license", m)[1] == 0 and license_scan.scan("mit éLicense", m)[1] == 0
    n, k, *_, base, labels, grade = license_scan.scan("// SPDX-License-Identifier: Apache-2.0 OR MIT\nMIT License", m)
    assert (k, base, labels, grade) == (1, "mit", "apache,mit", 1.0)
    got = license_scan.license_scan(odd_docs)
    assert got.count() == odd_docs.count() and license_scan.license_scan(no_docs).count() == 0
    empty = got.where("doc_id = 4").first()
    assert (empty["n_words"], empty["first_word"], empty["labels"]) == (0, None, "")


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    r = random.Random(2)
    terms = {"idiot": 3.0, "moron": 2.0, "disgusting": 4.0, "bad": 1.0}
    machine = toxicity.Automaton(terms, {})
    words = list(terms) + ["id1ot", "idiots", "diot", "dsgustng", "dissgustting", "bed", "", "moro", "mormon"]
    for _ in range(600):
        w = list(r.choice(list(terms)))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(w))
            w[at : at + r.randint(0, 1)] = r.choice(["", "x", "o", "i"])
        words.append("".join(w))
    for w in words:
        near = [(distance(w, t), -x) for t, x in terms.items() if distance(w, t) <= toxicity.edits_for(t)]
        got = machine.match(w)
        assert (got is not None) == bool(near) and (not near or got[1] == min(near)[0]), w
    stems = toxicity.Automaton({}, {"lowei": 2.0})
    assert stems.match("loweiung") == (2.0, 0) and stems.match("lower") is None


def test_context_tells_quotation_from_abuse():
    finder = toxicity.Finder({"idiot": 5.0}, {})
    abuse, quoted = finder.features("you are an idiot and that is all"), finder.features('he said the word "idiot" is an insult')
    assert abuse[0] == 5.0 and quoted[0] < 1.0 < quoted[4]


def test_toxicity_held_out(spark, odd_docs, no_docs):
    r = random.Random(8)
    rows = []
    for i in range(1500):
        words = [f"w{r.randint(0, 500)}" for _ in range(40)]
        bad = r.random() < 0.3
        if bad:
            words[r.randint(0, 39)] = r.choice(["rotten", "wretched", "vermin"])
        rows.append((i, " ".join(words), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"), held_out=toxicity.held_out_fifth())
    got = toxicity.score(docs, model).join(docs, "doc_id").where(toxicity.held_out_fifth()).collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.97
    assert toxicity.score(spark.createDataFrame([(1, "a rottten thing")], "doc_id long, text string"), model).first()["score"] > 0.3
    assert toxicity.score(odd_docs, model).count() == odd_docs.count() and toxicity.score(no_docs, model).count() == 0
    nothing = toxicity.train(docs, docs.select("doc_id", "toxic").limit(0))
    assert {r["score"] for r in toxicity.score(odd_docs, nothing).collect()} == {0.0}


def test_pipeline(spark, sample):
    import corpus_pipeline as cp

    docs, names = sample, [n for n, _ in cp.STAGES]
    assert names == ["quality rules", "language ID", "exact dedup", "near dedup", "packing"]
    for name, step in cp.STAGES[:-1]:
        docs = cp.stage(step(spark, docs, ""), "test")
        assert docs.columns == sample.columns
    texts = [r["text"] for r in docs.collect()]
    assert 0 < len(texts) == len(set(texts)) <= sample.count()
    pieces = cp.run(spark, "/root/testdata/sf0.001").collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in docs.collect()}
    none = sample.limit(0)
    for _, step in cp.STAGES:
        none = cp.stage(step(spark, none, ""), "test")
    assert none.count() == 0


def test_components_equal_union_find(spark):
    import random

    from kinetrail.llm.components import connected_components

    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(900, i) for i in range(200, 240)] + [(-5, 7), (7, 7), (300, 301), (301, 300)]
    pairs += [(rng.randrange(1000, 1120), rng.randrange(1000, 1120)) for _ in range(70)]
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in pairs:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"))
    assert {(r["node"], r["root"]) for r in got.collect()} == {(v, root(v)) for v in list(parent)}
    assert got.count() == len(parent)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
