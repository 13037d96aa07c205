"""Toxicity: a learned lexicon, found with misspellings by Levenshtein automata over its trie, weighed by context.

Learning takes a bounded sample of labelled rows (``SAMPLE_ROWS``, by a hash of the id; a documented parameter). Words,
and beginnings of words ("stems"), that toxic documents hold far more often than others (likelihood-ratio test) make the
lexicon. Its terms stand in a trie; the product of the trie with the terms' Levenshtein automata is made deterministic
lazily, so a word costs one table lookup a letter and most words leave the automaton after a few.

Each hit is weighed by a window of words around it: quotation marks, words of saying and words about words ("called",
"term") speak for quotation. Abusive and quoted mass enter a small logistic regression apart, fitted to the same sample.

Defined results
* every text gets a score: null or empty ones that of a text without hits; without usable labels all scores are 0;
* a row's labels are combined by maximum; null labels are not used; repeated rows are scored each; an empty table gives
  an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.byte_bpe import blocks
from kinetrail.llm.common import crc32_mod, quoted, stage

SAMPLE_ROWS = 20_000
#: Twice the logarithm of the likelihood ratio that a term needs, and the share of toxic documents among those with it.
MIN_RATIO, MIN_SHARE = 28.0, 0.8
STEM_SIZES = (4, 5, 6, 7)
CONTEXT = 6
#: A worker remembers so many words of at most so many letters.
CACHE_WORDS, CACHED_LETTERS = 400_000, 64
MAX_STATES = 100_000
STRIP = ".,;:!?…()[]{}<>|*_~#\"'`´“”„‟«»‹›‘’‚¡¿-–—/\\"
QUOTES = frozenset("\"“”„‟«»‹›`")
#: Words that tell of an utterance or of a word rather than insult.
SAYING = frozenset(
    "said says say saying told quote quoted quotes quoting wrote writes called calls calling word words term terms insult insults slur slurs "
    "dit disait écrit appelé mot mots terme insulte sagte sagt schrieb genannt wort wörter begriff beleidigung "
    "dijo dice escribió llamó llamado palabra palabras término insulto".split()
)


def edits_for(term: str) -> int:
    """The edit distance at which a word still counts as the term misspelled."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The lexicon's trie intersected with Levenshtein automata, made deterministic as words are read.

    ``terms``: {term: weight}; ``stems``: {beginning: weight}, matched without edits. A state is a set of (trie node,
    edits so far); the table of states is dropped when it reaches ``MAX_STATES`` and built anew.
    """

    def __init__(self, terms: dict[str, float], stems: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[tuple[float, int] | None] = [None]  # weight, allowed edits
        self.stem: list[float | None] = [None]
        self.allowed = [0]  # the most edits that any term below allows
        for word, weight in terms.items():
            node = self._node(word, edits_for(word))
            self.term[node] = (weight, edits_for(word))
        for word, weight in stems.items():
            self.stem[self._node(word, 0)] = weight
        self._reset()

    def _node(self, word: str, edits: int) -> int:
        node = 0
        self.allowed[0] = max(self.allowed[0], edits)
        for c in word:
            if c not in self.children[node]:
                self.children[node][c] = len(self.children)
                self.children.append({})
                self.term.append(None)
                self.stem.append(None)
                self.allowed.append(0)
            node = self.children[node][c]
            self.allowed[node] = max(self.allowed[node], edits)
        return node

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[float, int] | None] = []  # best (weight, edits) if a word ends here
        self.stems: list[float] = []  # weight of a stem completed here
        self.start = self._state({0: 0})

    def _state(self, costs: dict[int, int]) -> int:
        grown = list(costs.items())
        while grown:  # letters of the term that the word leaves out
            node, d = grown.pop()
            for child in self.children[node].values():
                if d + 1 <= self.allowed[child] and d + 1 < costs.get(child, 9):
                    costs[child] = d + 1
                    grown.append((child, d + 1))
        key = tuple(sorted(costs.items()))
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            hits = [(self.term[n][0], d) for n, d in key if self.term[n] and d <= self.term[n][1]]
            self.ends.append(min(hits, key=lambda h: (h[1], -h[0])) if hits else None)
            self.stems.append(max((self.stem[n] for n, d in key if d == 0 and self.stem[n] is not None), default=0.0))
        return found

    def _move(self, state: int, c: str) -> int:
        costs: dict[int, int] = {}
        for node, d in self.sets[state]:
            for letter, child in self.children[node].items():
                e = d + (letter != c)
                if e <= self.allowed[child] and e < costs.get(child, 9):
                    costs[child] = e
            if d + 1 <= self.allowed[node] and d + 1 < costs.get(node, 9):  # a letter too many
                costs[node] = d + 1
        to = self.moves[state][c] = self._state(costs) if costs else -1
        return to

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the closest term; a stem counts as edits 0 with its own weight."""
        if len(self.sets) > MAX_STATES:
            self._reset()
        state, stem, moves = self.start, 0.0, self.moves
        for c in word:
            to = moves[state].get(c)
            if to is None:
                to = self._move(state, c)
            if to < 0:
                return (stem, 0) if stem else None
            state = to
            stem = max(stem, self.stems[state])
        end = self.ends[state]
        if end and (end[1] == 0 or not stem):
            return max(end, (stem, 0)) if end[1] == 0 and stem else end
        return (stem, 0) if stem else None


FEATURES = ["exact_max", "exact_sum", "near_max", "near_sum", "quoted_sum", "density"]


class Finder:
    """Features of texts: the weighed hits."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], context: int = CONTEXT):
        self.machine, self.context = Automaton(terms, stems), context
        self.cache: dict[str, tuple[float, int] | None] = {}

    def features(self, text: str) -> list[float]:
        words = text.lower().split()
        cache, hits = self.cache, []
        for i, w in enumerate(words):
            try:
                hit = cache[w]
            except KeyError:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                hit = self.machine.match(w.strip(STRIP))
                if len(w) <= CACHED_LETTERS:
                    cache[w] = hit
            if hit:
                hits.append((i, *hit))
        if not hits:
            return [0.0] * len(FEATURES)
        exact, near, quoted_mass = [0.0], [0.0], 0.0
        for i, weight, edits in hits:
            around = words[max(0, i - self.context) : i + self.context + 1]
            signs = 2.0 * bool(QUOTES & set(words[i])) + 1.0 * any(QUOTES & set(w) for w in around) + 1.0 * any(w.strip(STRIP) in SAYING for w in around)
            quote = min(1.0, signs / 3)
            quoted_mass += weight * quote
            (near if edits else exact).append(weight * (1 - quote) / (1 + edits))
        return [max(exact), math.log1p(sum(exact)), max(near), math.log1p(sum(near)), math.log1p(quoted_mass), 100 * len(hits) / (len(words) + 20)]


@dataclass
class ToxicityModel:
    terms: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)  # by feature, then the intercept; empty: nothing learned


def _ratio(pos, neg, n_pos, n_neg):
    """Twice the log likelihood ratio of a term against no link with the label (columns)."""
    have, all_docs = pos + neg, n_pos + n_neg
    lack = all_docs - have

    def part(k, of, expected):
        return F.when(k > 0, k * F.log(k / (of * expected))).otherwise(F.lit(0.0))

    p = n_pos / all_docs
    return 2 * (part(pos, have, p) + part(neg, have, 1 - p) + part(n_pos - pos, lack, p) + part(n_neg - neg, lack, 1 - p))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method with a ridge penalty (not on the intercept); features are scaled inside."""
    scale = np.maximum(x.std(0), 1e-9)
    a = np.hstack([x / scale, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        g = a.T @ (p - y) + penalty @ w
        step = np.linalg.solve((a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + penalty, g)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    held_out=None,
    sample_rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """Learn from labelled rows that ``held_out`` (a condition on doc_id, default none) doesn't name."""
    marked = labels.select(quoted(id_col).alias("doc_id"), quoted(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    if held_out is not None:
        marked = marked.where(~held_out)
    marked = marked.groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y"))
    # sample_rows rows of 12 bytes: the bound of the broadcast
    sample = marked.orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    rows = stage(rows.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y"), "toxicity-sample")  # all rows of sampled ids
    total, n_pos = rows.agg(F.count("*"), F.sum("y")).first()
    n_pos = n_pos or 0
    n_neg = total - n_pos
    if not n_pos or not n_neg:
        return ToxicityModel()

    def count(batches: Iterator[pa.RecordBatch]):
        for part, texts in blocks(batches):
            pos, neg = Counter(), Counter()
            for text, y in zip(texts, part.column(2).to_pylist()):
                words = {w.strip(STRIP) for w in text.lower().split()} - {""}
                (pos if y else neg).update(words)
                (pos if y else neg).update({f"{w[:k]}*" for w in words for k in STEM_SIZES if len(w) >= k})
            keys = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([pos[k] for k in keys], pa.int64()), pa.array([neg[k] for k in keys], pa.int64())], ["term", "pos", "neg"])

    counts = rows.mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = counts.where(F.col("pos") >= MIN_SHARE * (F.col("pos") + F.col("neg")))
    ratio = _ratio(F.col("pos"), F.col("neg"), F.lit(float(n_pos)), F.lit(float(n_neg)))
    # a term needs this ratio within the sample, hence several of its toxic documents: the sample bounds the lexicon
    best = counts.withColumn("ratio", ratio).where(F.col("ratio") >= MIN_RATIO).orderBy(F.desc("ratio"), "term").collect()
    odds = {r["term"]: math.log((r["pos"] + 0.5) / (n_pos + 1)) - math.log((r["neg"] + 0.5) / (n_neg + 1)) for r in best}
    terms = {t: w for t, w in odds.items() if not t.endswith("*")}
    stems = {t[:-1]: w for t, w in odds.items() if t.endswith("*")}

    def measure(batches: Iterator[pa.RecordBatch]):
        finder = Finder(terms, stems)
        for part, texts in blocks(batches):
            found = pa.array([finder.features(t) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), found], ["doc_id", "y", "x"])

    measured = rows.mapInArrow(measure, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, y int, x array<double>")
    # rows that share an id are one, with their mean features: at most sample_rows rows reach the driver
    means = measured.groupBy("doc_id").agg(F.max("y").alias("y"), *[F.avg(F.col("x")[i]).alias(f"x{i}") for i in range(len(FEATURES))])
    means = means.orderBy("doc_id").toPandas()
    x = means[[f"x{i}" for i in range(len(FEATURES))]].to_numpy(float)
    return ToxicityModel(terms, stems, fit_logistic(x, means["y"].to_numpy(float)).tolist())


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score, predicted."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    weights = np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]):
        finder = Finder(model.terms, model.stems)
        for part, texts in blocks(batches):
            if len(weights):
                x = np.array([finder.features(t) for t in texts])
                p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -35, 35)))
            else:
                p = np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def held_out_fifth(id_col: str = "doc_id"):
    return crc32_mod(quoted(id_col), 5) == 0
