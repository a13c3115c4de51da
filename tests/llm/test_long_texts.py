"""Texts that repeat with a short period, unspaced texts, and texts of a megabyte."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from glyphmill.llm import byte_bpe, mixing, queries, suffix_dedup, token_counts, toxicity

WORDS = "the quick brown fox ünder 😀 日本 don't 12345 \n\t  x=y;".split(" ")


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def removed_by_force(texts, length):
    data = [t.encode() for t in texts]
    seen = {}
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((d, i))
    out = []
    for d, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for places in seen.values():
            if len(places) > 1:
                for k, i in places:
                    if k == d:
                        gone[i : i + length] = True
        runs = int((np.diff(np.r_[False, gone]) & gone).sum()) if len(b) else 0
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


def test_short_periods_equal_brute_force(spark):
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    texts = [noise(50) + part * (n // len(part)) + part[: n % len(part)] + noise(50) for part in ("a", "ab", "xyz", "lorem i", " ", noise(31)) for n in (39, 40, 41, 45, 79, 80, 81, 300)]
    texts += ["a" * 500, "a" * 39, "b" * 41, "ab" * 200 + "ba" * 200, "", "a" * 200 + "c" + "a" * 200]
    got = sorted(tuple(r) for r in suffix_dedup.digest(suffix_dedup.remove_repeats(frame(spark, texts), length=40)).collect())
    assert got == removed_by_force(texts, 40)


@pytest.mark.parametrize("part", [b"a", b"ab", b"  \n"])
def test_a_short_period_is_held_once_a_block(part):
    gram, _ = suffix_dedup.shape(400)
    data = np.frombuffer(part * (5_000_000 // len(part)), np.uint8)
    rows = [x for block in suffix_dedup.segments(data, 400, gram) for x in zip(*block, strict=True)]
    assert len(rows) < 30 and sum(int(n) * int(t) for _, _, n, _, t in rows) == len(data) - 399
    mixed = np.frombuffer(b"x" * 1000 + bytes(np.random.default_rng(1).integers(0, 256, 3000, dtype=np.uint8)) + b"yz" * 700, np.uint8)
    rows = [x for block in suffix_dedup.segments(mixed, 400, gram) for x in zip(*block, strict=True)]
    assert sum(int(n) * int(t) for _, _, n, _, t in rows) == len(mixed) - 399
    ends = np.cumsum([int(n) * int(t) for _, _, n, _, t in rows])
    assert [int(f) for _, f, *_ in rows] == [0, *ends[:-1]]


def test_megabytes_of_one_byte(spark):
    texts = ["a" * 4_000_000, "ab" * 1_000_000, "short", "é" * 300_000]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame(spark, texts)).drop("kept").collect()}
    assert [(got[i].n_bytes, got[i].n_removed) for i in range(4)] == [(4_000_000, 4_000_000), (2_000_000, 2_000_000), (5, 0), (600_000, 600_000)]


def long_texts():
    rng = random.Random(7)
    return [" ".join(rng.choices(WORDS, k=220_000)), "語" * 350_000, "x" * 100_000, "", " " * 1_000_000]


def test_token_counts_of_a_megabyte(spark):
    texts = long_texts()
    model = queries.tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(frame(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        n = len(sp.encode(t))
        assert got[i] == (len(t.encode()), n, n > 4096)


def test_only_short_pre_tokens_are_summed_up(spark):
    texts = ["文" * 5000 + str(i) for i in range(300)] + ["some words some words"] * 5
    assert all(len(p) <= token_counts._LONGEST_KEPT for p in token_counts.frequent_pre_tokens(frame(spark, texts), "text"))


def test_encoding_of_a_megabyte(spark):
    texts = long_texts()[:2] + ["ab" * 150_000]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = {r.doc_id: r for r in byte_bpe.round_trip(frame(spark, texts), queries.tokenizer_file("byte_bpe_50k.json").decode()).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_mixing_counts_a_megabyte_whole(spark):
    rows = [(i, t, "en", "src1", 1) for i, t in enumerate(long_texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.n_tokens for r in mixing.mix(docs, **queries.mix_options()).collect()}
    assert got == {i: -(-len(t.encode()) // 4) for i, t, *_ in rows}


def test_length_counts_by_its_square_root():
    matcher = toxicity.Matcher(toxicity.Lexicon({" scum ": 5.0}, [], -2.0, 1.0))
    at = lambda n: matcher.density(["scum", *["fine"] * (n - 1)])
    assert at(1) == at(100) == 5.0 and at(400) == pytest.approx(2.5) and at(10_000) == pytest.approx(0.5)
    assert matcher.density([]) == 0.0
