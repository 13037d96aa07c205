"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The likelihood of a word is the sum over
all its segmentations into pieces, by a forward pass over its characters; a text's score adds its words' logarithms.
Training is expectation-maximisation: a forward-backward pass gives each piece its expected count over all
segmentations, in each language.

The passes run over arrays of equally long words, all languages at once; a bounded cache per worker holds the vectors
of words seen. Training counts the words of every labelled text; its passes then go over distinct words, so they grow
with the vocabulary and not with the texts. Predictions cover every whole text.

Defined results
* words are runs of letters, lowered, and scored whole; beyond ``LONGEST`` letters the passes rescale as they go;
* every language is learned; where the table of probabilities would be over ``MAX_TABLE_BYTES``, training fails;
* null texts and texts without a letter: ``und`` with score 0; the same if no language could be learned;
* ``score`` is the posterior of the predicted language (0 to 1); ties go to the language that comes first by name;
* ``language_filter`` also asks that a text fits its language: its log-likelihood a letter, as low as the labelled
  training rows' lower tail allows; text in a language that was never learned, gibberish and letter noise don't;
* repeated rows are predicted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.llm.byte_bpe import blocks
from kinetrail.llm.common import crc32_mod, delete, held, quoted, stage

#: The most that the table of pieces x languages may take, on the driver and in each worker (about 1,000 languages).
MAX_TABLE_BYTES = 1 << 28
ROUNDS = 2
LONGEST = 24
#: Words from which a text's fit is judged at full strength; a shorter text may stray further.
FIT_WORDS = 50
#: What a worker's remembered words may take, and the longest word that is remembered.
CACHE_BYTES, CACHED_LETTERS = 48_000_000, 64
START = "▁"
_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in _LETTERS.findall(text.lower())]


class Pieces:
    """The vocabulary's text pieces; found in arrays of characters by a polynomial hash."""

    _BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
        texts = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)]
        # text is lowered, so only such pieces can ever match
        texts = sorted({t for t in texts if t == t.lower() and all(c == START or c.isalpha() for c in t) and t.rfind(START) <= 0})
        self.longest = max(map(len, texts))
        self.n = len(texts)  # index n: a character that no piece spells; n + 1: no piece
        hashes = np.zeros(self.n, np.uint64)
        for size in {len(t) for t in texts}:
            at = [i for i, t in enumerate(texts) if len(t) == size]
            chars = np.array([[ord(c) for c in texts[i]] for i in at], np.uint64)
            h = np.zeros(len(at), np.uint64)
            for k in range(size):
                h = self.add(h, chars[:, k])
            hashes[at] = h
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], order.astype(np.int32)

    def add(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return h * self._BASE + c + np.uint64(1)

    def find(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, h)
        at[at == self.n] = 0
        return np.where(self.keys[at] == h, self.ids[at], self.n + 1)

    def spans(self, chars: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """For words x characters: the piece of each span (start, end) in each word; spans without any are left out."""
        n, found = chars.shape[1], {}
        for i in range(n):
            h = np.zeros(len(chars), np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = self.add(h, chars[:, j - 1])
                ids = self.find(h)
                if j == i + 1:
                    ids[ids > self.n] = self.n
                if (ids <= self.n).any():
                    found[i, j] = ids
        return found


def _by_length(words: list[str], languages: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in ``words``, characters) of words of one length, so many at a time that the passes' arrays stay small."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        every = np.flatnonzero(sizes == size)
        most = max(1, min(20_000, 4_000_000 // (min(size, LONGEST) * languages), 4_000_000 // size))
        for at in np.split(every, range(most, len(every), most)):
            flat = np.frombuffer("".join([words[i] for i in at.tolist()]).encode("utf-32-le"), "<u4")
            yield at, flat.reshape(len(at), size).astype(np.uint64)


def _stretches(chars: np.ndarray, pieces: Pieces, back: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(first start, starts x sizes x words: the pieces there) for one stretch of starts after the other."""
    n, sizes = chars.shape[1], pieces.longest
    step = max(1, 2_000_000 // (sizes * len(chars)))
    for first in sorted(range(0, n, step), reverse=back):
        last = min(n, first + step)
        ids = np.full((last - first, sizes, len(chars)), pieces.n + 1, np.int32)
        h = np.zeros((len(chars), last - first), np.uint64)
        for k in range(min(sizes, n - first)):
            fit = min(last, n - k) - first  # starts whose span of k + 1 characters ends within the word
            h = pieces.add(h[:, :fit], chars[:, first + k : first + k + fit])
            ids[:fit, k] = pieces.find(h).T
        ids[:, 0][ids[:, 0] > pieces.n] = pieces.n
        yield first, ids


def _long_forward(chars: np.ndarray, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """The forward pass over words of one length, rescaled on its way: a ring holds what the next ends have so far."""
    sizes = pieces.longest
    ring = np.zeros((sizes + 1, len(chars), table.shape[1]))
    ring[0] = 1
    scale = np.zeros(ring.shape[1:])
    ahead = np.arange(1, sizes + 1)
    for first, ids in _stretches(chars, pieces):
        for i, found in enumerate(ids, first):
            here = i % (sizes + 1)
            ring[(i + ahead) % (sizes + 1)] += ring[here] * table[found]
            ring[here] = 0
            if i % 8 == 7:
                top = ring.max(0)
                ring /= top
                scale += np.log(top)
    return np.log(ring[chars.shape[1] % (sizes + 1)]) + scale


def _long_counts(chars: np.ndarray, lang: np.ndarray, counts: np.ndarray, total: np.ndarray, pieces: Pieces, table: np.ndarray) -> None:
    """Adds to ``total`` the expected uses of pieces in words of one length, rescaled as in :func:`_long_forward`."""
    n, sizes, ahead = chars.shape[1], pieces.longest, np.arange(1, pieces.longest + 1)
    alpha, log_scale = np.zeros((n + 1, len(chars))), np.zeros((n + 1, len(chars)))
    ring, scale = np.zeros((sizes + 1, len(chars))), np.zeros(len(chars))
    ring[0] = 1
    for first, ids in _stretches(chars, pieces):
        for i, found in enumerate(ids, first):
            here = i % (sizes + 1)
            alpha[i], log_scale[i] = ring[here], scale
            ring[(i + ahead) % (sizes + 1)] += ring[here] * table[found, lang]
            ring[here] = 0
            if i % 8 == 7:
                top = ring.max(0)
                ring /= top
                scale = scale + np.log(top)
    whole = np.log(ring[n % (sizes + 1)]) + scale
    ring, scale = np.zeros((sizes + 1, len(chars))), np.zeros(len(chars))
    ring[n % (sizes + 1)] = 1
    for first, ids in _stretches(chars, pieces, back=True):
        for i in range(first + len(ids) - 1, first - 1, -1):
            found = ids[i - first]
            uses = table[found, lang] * ring[(i + ahead) % (sizes + 1)]
            np.add.at(total, (found, lang[None]), alpha[i] * uses * (np.exp(log_scale[i] + scale - whole) * counts))
            ring[i % (sizes + 1)] = uses.sum(0)
            if i % 8 == 7:
                top = ring.max(0)
                ring /= top
                scale = scale + np.log(top)


def log_likelihoods(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """words x languages: the logarithm of the sum over all segmentations. ``table``: pieces x languages."""
    out = np.zeros((len(words), table.shape[1]))
    for at, chars in _by_length(words, table.shape[1]):
        n = chars.shape[1]
        if n > LONGEST + 1:
            out[at] = _long_forward(chars, pieces, table)
            continue
        alpha = [np.ones((len(at), table.shape[1]))] + [np.zeros((len(at), table.shape[1])) for _ in range(n)]
        for (i, j), ids in pieces.spans(chars).items():  # in order of i: alpha[i] is complete
            alpha[j] += alpha[i] * table[ids]
        out[at] = np.log(alpha[n])
    return out


def expected_counts(words: list[str], langs: np.ndarray, counts: np.ndarray, pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """pieces x languages: expected uses of each piece over all segmentations; word i comes counts[i] times in langs[i]."""
    total = np.zeros_like(table)
    for at, chars in _by_length(words):
        n, lang = chars.shape[1], langs[at]
        if n > LONGEST + 1:
            _long_counts(chars, lang, counts[at], total, pieces, table)
            continue
        spans = pieces.spans(chars)
        prob = {k: table[ids, lang] for k, ids in spans.items()}
        alpha = [np.ones(len(at))] + [np.zeros(len(at)) for _ in range(n)]
        for (i, j), p in prob.items():
            alpha[j] += alpha[i] * p
        beta = [np.zeros(len(at)) for _ in range(n)] + [np.ones(len(at))]
        for (i, j), p in reversed(list(prob.items())):
            beta[i] += beta[j] * p
        for (i, j), p in prob.items():
            np.add.at(total, (spans[i, j], lang), alpha[i] * p * beta[j] / alpha[n] * counts[at])
    total[-1] = 0
    return total


def _normalised(counts: np.ndarray) -> np.ndarray:
    """Probabilities with a little mass for every piece; the last row (no piece) stays 0."""
    p = counts + 0.01
    p[-1] = 0
    return p / p.sum(0)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray
    vocabulary: str
    #: By language: the usual log-likelihood a letter and how far below it a text may be; None: fit isn't judged.
    fit: np.ndarray | None = None


def _load(path: str) -> Pieces:
    return held("language ID", path, Pieces)


def train(
    docs: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    held_out=None,
    sample_docs: int | None = None,
    rounds: int = ROUNDS,
    judge_fit: bool = True,
) -> LanguageModel:
    """Learn from rows with a language that ``held_out`` (a condition on doc_id, default none) doesn't name.

    All of them are used. With ``sample_docs`` only about so many documents of each language are: those whose hashed id
    falls under a threshold set by the language's count.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"), quoted(lang_col).alias("lang")).where("lang is not null")
    if held_out is not None:
        rows = rows.where(~held_out)
    pieces = _load(vocabulary)
    most = MAX_TABLE_BYTES // (8 * (pieces.n + 2))
    found = rows.groupBy("lang").count().limit(most + 1).collect()
    languages = sorted(r["lang"] for r in found)
    if len(languages) > most:
        raise ValueError(f"over {most:,} values of {lang_col!r}: a table of pieces by language would take over {MAX_TABLE_BYTES:,} bytes")
    table = _normalised(np.zeros((pieces.n + 2, max(1, len(languages)))))
    if not languages:
        return LanguageModel([], table, vocabulary)
    rows = rows.withColumn("lang", F.col("lang").cast("string"))
    if sample_docs is not None:
        place = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 62)) / float(1 << 62)
        shares = spark.createDataFrame([(r["lang"], sample_docs / r["count"]) for r in found], "lang string, share double")
        rows = rows.join(F.broadcast(shares), "lang").where(place < F.col("share"))  # a row a language
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]):
        for part, texts in blocks(batches, 0):
            seen = Counter()
            for lang, text in zip(part.column(1).to_pylist(), texts):
                seen.update((number[lang], START + w) for w in words_of(text) if w)
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], ["lang", "word", "n"])

    words = rows.select("text", "lang").mapInArrow(count, "lang int, word string, n long")
    words = stage(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(table)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared):
            known, total = _load(vocabulary), np.zeros_like(shared.value)
            for batch in batches:
                total += expected_counts(batch.column(1).to_pylist(), batch.column(0).to_numpy(), batch.column(2).to_numpy(), known, shared.value)
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        # at most pieces x languages rows
        sums = words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros_like(table)
        counts[sums["piece"], sums["lang"]] = sums["n"]
        table = _normalised(counts)
    delete(spark, words.staged_at)
    model = LanguageModel(languages, table, vocabulary)
    if judge_fit:
        model.fit = _fit(rows, model)
    return model


def _fit(rows: DataFrame, model: LanguageModel) -> np.ndarray:
    """languages x (median, allowance) of the labelled rows' fit: 2.5 times the way from the median to the lowest
    hundredth, half a nat at least, and more for a language with few rows."""
    shared, number, vocabulary = rows.sparkSession.sparkContext.broadcast(model.table), {x: i for i, x in enumerate(model.languages)}, model.vocabulary

    def measure(batches: Iterator[pa.RecordBatch]):
        scorer = Scorer(_load(vocabulary), shared.value)
        for part, texts in blocks(batches, 1):
            langs = [number[x] for x in part.column(0).to_pylist()]
            found = [(k, v[k] / letters, words) for k, v, (words, letters) in zip(langs, scorer.score(texts), map(_extent, scorer.cut)) if v is not None]
            k, fit, words = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(fit, pa.float64()), pa.array(words, pa.int64())], ["k", "fit", "words"])

    fits = rows.select("lang", "text").mapInArrow(measure, "k int, fit double, words long")
    long = F.when(F.col("words") >= FIT_WORDS, F.col("fit"))
    low, mid = (F.coalesce(F.percentile_approx(long, q), F.percentile_approx("fit", q)) for q in (0.01, 0.5))
    out = np.tile([0.0, np.inf], (len(model.languages), 1))
    for r in fits.groupBy("k").agg(low.alias("low"), mid.alias("mid"), F.count("*").alias("n")).collect():  # a row a language
        out[r["k"]] = r["mid"], max(0.5, 2.5 * (r["mid"] - r["low"])) + 2 / np.sqrt(r["n"])
    return out


def _extent(words: list[str]) -> tuple[int, int]:
    """(words, letters)"""
    return len(words) - words.count(""), sum(map(len, words))


class Scorer:
    """Log-likelihood vectors of words, with a bounded cache."""

    def __init__(self, pieces: Pieces, table: np.ndarray):
        self.pieces, self.table = pieces, table
        self.row: dict[str, int] = {}
        self.cut: list[list[str]] = []  # the words of the texts scored last
        self.vectors = np.zeros((0, table.shape[1]))

    def score(self, texts: list[str]) -> list[np.ndarray | None]:
        """The sum over each text's words; None for a text without a letter."""
        self.cut = cut = [words_of(t) for t in texts]
        new = set().union(*cut).difference(self.row) - {""}
        if (len(self.row) + len(new)) * (8 * self.table.shape[1] + 120) > CACHE_BYTES:
            new = set().union(*cut) - {""}
            self.row, self.vectors = {}, self.vectors[:0]
        words = sorted(new, key=lambda w: len(w) > CACHED_LETTERS)
        if words:
            self.row.update(zip(words, range(len(self.vectors), len(self.vectors) + len(words))))
            self.vectors = np.concatenate([self.vectors, log_likelihoods([START + w for w in words], self.pieces, self.table)])
        get = self.row.__getitem__
        sums = [self.vectors[np.fromiter((get(w) for w in ws if w), np.int64)].sum(0) if any(ws) else None for ws in cut]
        for w in reversed(words):
            if len(w) <= CACHED_LETTERS:
                break
            del self.row[w]
        self.vectors = self.vectors[: len(self.row)]
        return sums


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, lang_pred, score; or, with ``carry``, these columns of ``docs`` instead of doc_id."""
    columns = [quoted(c) for c in carry] if carry else [quoted(id_col).alias("doc_id")]
    rows = docs.select(*columns, quoted(text_col).alias("kt_text"))
    at, shared = len(columns), docs.sparkSession.sparkContext.broadcast(model.table)
    languages, vocabulary = model.languages, model.vocabulary

    def run(batches: Iterator[pa.RecordBatch]):
        scorer = Scorer(_load(vocabulary), shared.value)
        for part, texts in blocks(batches, at):
            names, scores = [], []
            for v in scorer.score(texts):
                if v is None or not languages:
                    names.append("und")
                    scores.append(0.0)
                    continue
                best = int(np.argmax(v))
                names.append(languages[best])
                scores.append(float(1 / np.exp(v - v[best]).sum()))
            yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names[:at], "lang_pred", "score"])

    schema = rows.drop("kt_text").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)


def held_out_quarter(id_col: str = "doc_id"):
    return crc32_mod(quoted(id_col), 4) == 2


def language_filter(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text is in one of the model's languages with a posterior of ``min_score`` or more.

    The posterior only compares the learned languages; that the text is in any of them shows in its fit to the best.
    Without any learned language all rows stay: there is nothing to judge by.
    """
    if not model.languages:
        return docs
    at, shared, vocabulary = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model.table), model.vocabulary

    fit = model.fit

    def fits(v: np.ndarray, cut: list[str]) -> bool:
        if fit is None:
            return True
        words, letters = _extent(cut)
        usual, allowed = fit[int(np.argmax(v))]
        return bool(v.max() / letters >= usual - allowed * np.sqrt(max(1, FIT_WORDS / words)))

    def run(batches: Iterator[pa.RecordBatch]):
        scorer = Scorer(_load(vocabulary), shared.value)
        for part, texts in blocks(batches, at):
            keep = [v is not None and 1 / np.exp(v - v.max()).sum() >= min_score and fits(v, w) for v, w in zip(scorer.score(texts), scorer.cut)]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
