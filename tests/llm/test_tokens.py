"""Byte-level BPE against tiktoken; packing against the tokenizer and its own invariants."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinetrail.llm import byte_bpe, packing

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBPE(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(bpe):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={v: k for k, v in bpe.bytes_of.items()}, special_tokens={})


def ids(b):
    return np.frombuffer(b, "<u4").tolist()


def test_rank_queue_pops_in_order():
    r = random.Random(3)
    q, want = byte_bpe.RankQueue(70_000), sorted(r.sample(range(70_000), 500))
    for x in r.sample(want, len(want)):
        q.bucket(x).append(x)
    got = []
    while (p := q.pop()) is not None:
        got.append(p[0])
    assert got == want


def test_bpe_hard_texts(bpe, reference):
    r = random.Random(5)
    texts = ["", "a" * 4001, "ab" * 999, "banana" * 300, " " * 777, "\n \n  x", "x　 \x85y\x1c z", "don't 'S 're", "😀é" * 40, "".join(r.choice("ab") for _ in range(9000)), "".join(chr(r.randint(1, 0x2FFF)) for _ in range(3000))]
    for text, out in zip(texts, bpe.encode_block(texts)):
        assert ids(out) == reference.encode_ordinary(text) and bpe.decode(out).decode() == text


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_bpe_any_text(text):
    import tiktoken

    bpe = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={v: k for k, v in bpe.bytes_of.items()}, special_tokens={})
    out = bpe.encode_block([text])[0]
    assert ids(out) == enc.encode_ordinary(text) and bpe.decode(out) == text.encode()


def test_bpe_query(odd_docs, odd_rows, no_docs, reference):
    got = sorted((str(r["doc_id"]), list(r["ids"])) for r in byte_bpe.bpe_encode(odd_docs, RANKS, public_tokenizers.PATTERN).collect())
    assert got == sorted((str(r[0]), reference.encode_ordinary(r[1] or "")) for r in odd_rows)
    back = byte_bpe.bpe_decode(byte_bpe.bpe_encode(odd_docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r["decoded"]).decode() for r in back.collect()) == sorted(r[1] or "" for r in odd_rows)
    assert byte_bpe.bpe_digests(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_tokenizer_cache_is_exact():
    t = packing.WordTokenizer(WORDS)
    texts = ["Hello, World! hello world", "İstanbul ΣΑΣ naïve ß STRASSE É é", "a\x1cb c\x85d", "<|endoftext|>x 'Twas don't 12.5 %$#", "é é", " ", "ﬁ…!?.,;:"]
    for _ in range(2):
        for text, out in zip(texts, t.encode(texts, 2)):
            assert np.frombuffer(out, t.kind).tolist() == [*t.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_forms_of_a_word_share_their_pieces():
    t = packing.WordTokenizer(WORDS)
    t.encode(["haus &&& - 1 9 . , (", "straße 's"], 2)
    library, asked = t.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    t.tokenizer = Counting()
    texts = ["Haus&&& haus-haus, (HAUS 1991.", "Straße's 99-haus haus."]
    for text, out in zip(texts, t.encode(texts, 2)):
        assert np.frombuffer(out, t.kind).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
    assert not asked


def test_pieces_equal_the_library_on_latin_letters_marks_and_special_strings():
    rng, t = np.random.default_rng(3), packing.WordTokenizer(WORDS)
    assert t.finer
    wide, narrow = [chr(i) for i in range(256)], [*"a'strevmldE.,9 ²é\n", "<|endoftext|>", "Σ", "İ", "\u0301"]
    texts = ["".join(rng.choice(x, 14)) for x in (wide, narrow) for _ in range(1500)]
    texts += ["<|ENDOFTEXT|> a", "a<|endoftext|>", "<|endoftext|> b", "<|StartOfText|>", "ab" * 200, "AB" * 200 + ".", "Σ" * 100]
    for _ in range(2):
        for text, out in zip(texts, t.encode(texts, 2)):
            assert np.frombuffer(out, t.kind).tolist() == [*t.tokenizer.encode(text, add_special_tokens=False).ids, 2], text
    assert max(map(len, t.cache)) <= packing.CACHE_CHARS
    plain = packing.WordTokenizer(WORDS)
    plain.finer = False  # as for a tokenizer that cuts otherwise
    assert plain.encode(texts[:200], 2) == t.encode(texts[:200], 2)


def check(pieces, docs, window):
    t = packing.WordTokenizer(WORDS)
    tokens = defaultdict(list)
    for i, text, *_ in docs:
        tokens[i].append(np.array([*t.tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4"))
    spans, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert any(len(x) == p["doc_tokens"] and zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in tokens[p["doc_id"]])
        spans[p["doc_id"]].append((p["start"], p["length"]))
        seqs[p["sequence_id"]].append((p["offset"], p["length"]))
    for i, xs in tokens.items():
        assert sum(n for _, n in spans[i]) == sum(map(len, xs))
    for s, xs in seqs.items():
        at = 0
        for offset, n in sorted(xs):
            assert offset == at and n > 0
            at += n
        assert at == window if s < max(seqs) else at <= window
    assert sorted(seqs) == list(range(len(seqs)))


@pytest.mark.parametrize("targets,queues", [(None, 255), ({"s0": 1.0, "s1": 3.0}, 255), (None, 1)])
def test_pack(odd_docs, odd_rows, targets, queues):
    pieces = packing.pack(odd_docs, WORDS, targets, window=256, max_queues=queues).collect()
    check(pieces, odd_rows, 256)


def test_mixture_deviates_by_less_than_its_queues():
    totals = [50_000, 30_011, 7, 19_982]
    mix = packing.Mixture(totals, totals, 100)
    edges = mix.starts(0, -(-sum(totals) // 100))
    assert (np.diff(edges, axis=0) >= 0).all() and edges[-1].tolist() == totals
    due = np.arange(len(edges))[:, None] * 100 * np.array(totals) / sum(totals)
    assert np.abs(edges - due)[:-1].max() < len(totals)
    assert (edges.sum(1) == np.minimum(np.arange(len(edges)) * 100, sum(totals))).all()


def test_pack_nothing(no_docs):
    assert packing.pack(no_docs, WORDS).count() == 0


def played(totals, weights, window):
    """Tokens (queue, place) in the order of a deficit round-robin, played one by one: the queue whose next token is due first."""
    import heapq

    due = [(0.5 / w, k, 0) for k, (n, w) in enumerate(zip(totals, weights)) if n]
    heapq.heapify(due)
    order = []
    while due:
        _, k, x = heapq.heappop(due)
        order.append((k, x))
        if x + 1 < totals[k]:
            heapq.heappush(due, ((x + 1.5) / weights[k], k, x + 1))
    return [order[i : i + window] for i in range(0, len(order), window)]


@pytest.mark.parametrize("weights", [[5.0, 3.1, 0.013, 1.0, 1.0], [1.0, 1.0, 1.0, 1.0, 1.0], [0.3, 7.7, 2.2, 0.9, 40.0]])
def test_pack_equals_played_round_robin(spark, weights):
    r = np.random.default_rng(3)
    sources = ["a", "b", "c", None, "e"]
    rows = [(i, " ".join(["word"] * int(r.integers(0, 60))), sources[int(r.integers(0, 5))]) for i in range(300)]
    rows.append((300, "word " * 2000, "c"))
    rows.sort(key=lambda x: str(x[2]))  # a table in order of sources: slices cross borders
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    pieces = packing.pack(docs, WORDS, dict(zip(sources, weights)), window=64).collect()
    queue = [None, "a", "b", "c", "e"]  # as the operator numbers them
    tokens, place = {}, {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        tokens.setdefault(p["doc_id"], (p["source"], p["doc_tokens"]))
    totals = [sum(n for s, n in tokens.values() if s == q) for q in queue]
    before = dict.fromkeys(queue, 0)
    for i, _, s in rows:
        place[i] = before[s]
        before[s] += tokens[i][1]
    got = {}
    for p in pieces:
        for k in range(p["length"]):
            got[p["sequence_id"], p["offset"] + k] = (queue.index(p["source"]), place[p["doc_id"]] + p["start"] + k)
    by = dict(zip(sources, weights))
    want = {(i, k): x for i, w in enumerate(played(totals, [by[q] for q in queue], 64)) for k, x in enumerate(sorted(w))}
    assert got == want


def test_many_sources_each_keep_their_share(spark):
    """90 sources, four of them with queues of their own: in every window each has its share, give or take a few tokens."""
    rows = [(i, " ".join(["word"] * 40), f"s{i % 90}") for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    pieces = packing.pack(docs, WORDS, window=1024, max_queues=4).collect()
    check(pieces, rows, 1024)
    got = defaultdict(int)
    for p in pieces:
        got[p["sequence_id"], p["source"]] += p["length"]
    full = max(s for s, _ in got)
    shares = [got[s, f"s{k}"] for s in range(full) for k in range(90)]
    assert min(shares) >= 1024 // 90 - 4 and max(shares) <= 1024 // 90 + 5
    rare = packing.pack(docs, WORDS, {"s7": 1.0, "s8": 3.0}, window=1024, max_queues=2).collect()  # what targets name has its queue
    first = [sum(p["length"] for p in rare if p["sequence_id"] == 0 and p["source"] == s) for s in ("s7", "s8")]
    assert abs(first[1] - 3 * first[0]) <= 4
