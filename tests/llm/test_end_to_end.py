"""Language ID and toxicity from rows to scores against plain Python: counts, models and predictions."""

import math
import random
from functools import cache

import numpy as np
import public_tokenizers
import sentencepiece

from kinetrail.llm import language_id, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def plain_vocabulary() -> set[str]:
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    kinds = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    texts = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(k(i) for k in kinds))
    return {t for t in texts if t == t.lower() and all(c == "▁" or c.isalpha() for c in t) and t.rfind("▁") <= 0}


def segmentations(word: str, known: set[str]):
    """All ways to spell a word by pieces; a character that is no piece stands for itself, as the unknown piece ''."""

    @cache
    def rest(at: int) -> tuple[tuple[str, ...], ...]:
        if at == len(word):
            return ((),)
        found = []
        for end in range(at + 1, len(word) + 1):
            piece = word[at:end]
            if piece in known or end == at + 1:
                found += [(piece if piece in known else "", *tail) for tail in rest(end)]
        return tuple(found)

    return rest(0)


def test_language_id_from_rows_to_scores(spark):
    """Two rounds of expectation-maximisation by enumeration, then the posterior of every text."""
    known = plain_vocabulary()
    rows = [
        (1, "the cat sat on a mat, The cat!", "en"), (2, "a dog and the sun", "en"), (3, None, "en"), (4, "le chat est là", "fr"), (5, "un chien et le soleil", "fr"),
        (6, "the sun", None), (7, "le soleil 123", None), (8, "...", None), (9, "ça va Ωх", "fr"), (10, "", "en"), (11, "cat chat", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.train(docs, PIECES, judge_fit=False)
    words_of = lambda t: ["▁" + w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()]
    vocabulary = [*sorted(known), ""]
    p = {lang: dict.fromkeys(vocabulary, 1 / len(vocabulary)) for lang in ("en", "fr")}
    spelled = {w: segmentations(w, known) for _, t, _ in rows for w in words_of(t)}
    chance = lambda pieces, q: math.prod(q[x] for x in pieces)
    for _ in range(2):
        uses = {lang: dict.fromkeys(vocabulary, 0.0) for lang in p}
        for _, text, lang in rows:
            for w in words_of(text) if lang else ():
                whole = sum(chance(s, p[lang]) for s in spelled[w])
                for s in spelled[w]:
                    for piece in s:
                        uses[lang][piece] += chance(s, p[lang]) / whole
        p = {lang: {x: (n + 0.01) / (sum(u.values()) + 0.01 * len(u)) for x, n in u.items()} for lang, u in uses.items()}
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    for i, text, _ in rows:
        words = words_of(text)
        if not words:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        like = {lang: sum(math.log(sum(chance(s, q) for s in spelled[w])) for w in words) for lang, q in p.items()}
        best = max(sorted(like), key=like.get)
        assert got[i]["lang_pred"] == best and math.isclose(got[i]["score"], 1 / sum(math.exp(v - like[best]) for v in like.values()), rel_tol=1e-6), i


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_features(text: str, terms: dict[str, float], stems: dict[str, float]) -> list[float]:
    """The weighed hits by comparing every word with every term."""
    words = (text or "").lower().split()
    bare = [w.strip(toxicity.STRIP) for w in words]
    hits = []
    for i, w in enumerate(bare):
        near = [(distance(w, t), -x) for t, x in terms.items()]
        near = [(d, x) for (d, x), t in zip(near, terms) if d <= toxicity.edits_for(t)]
        stem = max((x for s, x in stems.items() if w.startswith(s)), default=0.0)
        if near and min(near)[0] == 0:
            hits.append((i, max(-min(near)[1], stem), 0))
        elif stem:
            hits.append((i, stem, 0))
        elif near:
            hits.append((i, -min(near)[1], min(near)[0]))
    if not hits:
        return [0.0] * 6
    exact, near_, quoted = [0.0], [0.0], 0.0
    for i, weight, edits in hits:
        around = words[max(0, i - 6) : i + 7]
        quotes = lambda w: any(c in toxicity.QUOTES for c in w)
        signs = 2 * quotes(words[i]) + any(map(quotes, around)) + any(w.strip(toxicity.STRIP) in toxicity.SAYING for w in around)
        share = min(1.0, signs / 3)
        quoted += weight * share
        (near_ if edits else exact).append(weight * (1 - share) / (1 + edits))
    return [max(exact), math.log1p(sum(exact)), max(near_), math.log1p(sum(near_)), math.log1p(quoted), 100 * len(hits) / (len(words) + 20)]


def test_toxicity_from_rows_to_scores(spark):
    """The lexicon by counting, features by edit distance to every term, the fit by its gradient, scores by the formula."""
    r = random.Random(4)
    mild = "river stone cloud quiet market window garden letter bridge candle forest harbour".split()
    rows, labels = [], []
    for i in range(160):
        words = r.choices(mild, k=14)
        toxic = i % 4 == 0
        if toxic:
            words[3], words[9] = r.choice(["vileword", "vileword", "vilewort"]), "grubling"
        elif i % 9 == 0:
            words[5] = '"vileword"'
        rows.append((i, " ".join(words) + ".") if i % 31 else (i, None))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    truth = dict(labels)
    pos, neg = {}, {}
    for i, text in rows:
        words = {w.strip(toxicity.STRIP) for w in (text or "").lower().split()} - {""}
        for term in words | {f"{w[:k]}*" for w in words for k in toxicity.STEM_SIZES if len(w) >= k}:
            side = pos if truth[i] else neg
            side[term] = side.get(term, 0) + 1
    n1, n0 = sum(truth.values()), len(rows) - sum(truth.values())
    part = lambda k, e: k * math.log(k / e) if k else 0.0
    chosen = {}
    for term in pos.keys() | neg.keys():
        a, b = pos.get(term, 0), neg.get(term, 0)
        p = n1 / (n0 + n1)
        ratio = 2 * (part(a, (a + b) * p) + part(b, (a + b) * (1 - p)) + part(n1 - a, (n0 + n1 - a - b) * p) + part(n0 - b, (n0 + n1 - a - b) * (1 - p)))
        if a >= toxicity.MIN_SHARE * (a + b) and ratio >= toxicity.MIN_RATIO:
            chosen[term] = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
    terms = {t: w for t, w in chosen.items() if not t.endswith("*")}
    stems = {t[:-1]: w for t, w in chosen.items() if t.endswith("*")}
    assert terms and model.terms.keys() == terms.keys() and model.stems.keys() == stems.keys()
    assert all(math.isclose(model.terms[t], w) for t, w in terms.items()) and all(math.isclose(model.stems[t], w) for t, w in stems.items())
    x = np.array([plain_features(text, terms, stems) for _, text in rows])
    y = np.array([truth[i] for i, _ in rows], float)
    w = np.array(model.weights)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    scale = np.maximum(x.std(0), 1e-9)
    gradient = np.append((x / scale).T @ (p - y) + w[:-1] * scale, (p - y).sum() + 1e-6 * w[-1])
    assert np.abs(gradient).max() < 1e-5
    got = {q["doc_id"]: q for q in toxicity.score(docs, model).collect()}
    assert np.allclose([got[i]["score"] for i, _ in rows], p, atol=1e-9) and all(got[i]["predicted"] == int(q >= 0.5) for (i, _), q in zip(rows, p))
