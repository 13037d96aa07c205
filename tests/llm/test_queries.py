"""The registered queries themselves, columns and digests included, against plain Python over a small table."""

import hashlib
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
import xxhash

from kinetrail.llm import queries

SF = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_op7(spark, docs):
    from kinetrail.llm import byte_bpe

    bpe = byte_bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={v: k for k, v in bpe.bytes_of.items()}, special_tokens={})
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op7_byte_bpe(spark, SF).collect()}
    for i, text in docs.items():
        ids = enc.encode_ordinary(text)
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert got[i] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_op8(spark, docs):
    prints = {}
    for i, text in docs.items():
        words = re.findall(f"[^{WS}]+", lower(text))
        grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in docs}
    for i in sorted(docs):  # the smallest id reachable
        todo, seen = [i], {i}
        while todo:
            x = todo.pop()
            near = [j for j in docs if j not in seen and (prints[x] ^ prints[j]).bit_count() <= 3]
            seen.update(near)
            todo += near
        root[i] = min(seen)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in docs}


def test_op6_base(spark, docs):
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    got = {r["doc_id"]: r for r in queries.op6_license_scan(spark, SF).collect()}
    for i, text in docs.items():
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
        hits = [(k, label) for k in range(len(words)) for p, label in phrases.items() if tuple(words[k : k + len(p)]) == p]
        starts, base = [k for k, _ in hits], {label for _, label in hits}
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)))
        assert base <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op2_and_op10(spark, docs):
    for query, mod, rest, column in ((queries.op2_toxicity, 5, 0, "predicted"), (queries.op10_language_id, 4, 2, "lang_pred")):
        rows = query(spark, SF).collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(docs)
        for r in rows:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) and 0 <= r["score"] <= 1 and r[column] is not None
            if column == "predicted":
                assert r["predicted"] == int(r["score"] >= 0.5)
            elif not any(map(str.isalpha, docs[r["doc_id"]])):
                assert r["lang_pred"] == "und"


def test_op3(spark, docs):
    from kinetrail.llm.packing import WordTokenizer

    enc = WordTokenizer(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    pieces = {}
    for r in queries.op3_packing(spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    filled = {}
    for i, text in docs.items():
        ids, at = [*enc.encode(text, add_special_tokens=False).ids, 2], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
            at += r["length"]
            filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert at == len(ids)
    for s, parts in filled.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 4096 or s == max(filled) and at < 4096
