"""Byte-level BPE against the rank files' own library, and back."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from cindergrid.llm import bpe, registry

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "\n\n \t x", "don't DON'T we'll 's", "a" * 3000, "ab" * 2000, "x    y", "ab՘c \U00016d40 \U000107bbᛪ2", "日本語 テスト, ελληνικά 12³४ é", "\x1c\x1d a\x85b", "😀" * 50 + "�", "<|endoftext|> </s>", "0" * 999]


def own(path, pattern=public_tokenizers.PATTERN):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_pieces_are_the_vocabulary():
    ranks = bpe.read_ranks(bpe.default_vocabulary())
    codec = bpe.codec(*bpe.codec_spec())
    assert {t: int(np.frombuffer(i, "<u4")[0]) for t, i in codec.whole.items()} == ranks
    assert all(codec.pieces.encode(bpe.signs(t)) == [r] for t, r in ranks.items())


@pytest.mark.parametrize("path", [None, MULTI])
def test_ids_are_the_librarys(path):
    codec, other = bpe.codec(*bpe.codec_spec(path)), own(path or bpe.default_vocabulary())
    rng = random.Random(7)
    wide = [c for c in map(chr, rng.sample(range(0x110000), 20000)) if not 0xD800 <= ord(c) < 0xE000]
    signs = "abc de'tS1 2\n\t.,!  é漢字😀՘\U00016d40"
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(3000)] + [" ".join(wide[i:i + 40]) for i in range(0, len(wide), 40)] + ["".join(wide[i:i + 40]) for i in range(0, len(wide), 40)]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(t), t
        assert codec.decode(ids) == t.encode()


def test_tokens_that_no_merge_reaches():
    """A match that is a token as a whole is that token."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"cd": 300}
    codec, other = bpe.codec(bpe.model_of(ranks), bpe.exactly(public_tokenizers.PATTERN), bpe.narrowed(public_tokenizers.PATTERN)), tiktoken.Encoding("o", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in ("abc", "abcd", "cd", "xcd abc"):
        assert np.frombuffer(codec.encode(t), "<u4").tolist() == other.encode_ordinary(t)


def test_rows(spark):
    texts = [(1, None), (2, ""), (None, "ab"), (3, "word " * 40000), (3, "word"), (3, "word"), *[(10 + i, t) for i, t in enumerate(ODD)]]
    docs = spark.createDataFrame([(i, t, b"x", b"y") for i, t in texts], "doc_id long, text string, ids binary, decoded binary")
    spec, other = bpe.codec_spec(), own(bpe.default_vocabulary())
    got = bpe.decode(bpe.encode(docs, spec), spec)
    assert got.columns == ["doc_id", "ids", "decoded"]
    got = sorted((r.doc_id or 0, tuple(np.frombuffer(r.ids, "<u4").tolist()), bytes(r.decoded)) for r in got.collect())
    assert got == sorted((i or 0, tuple(other.encode_ordinary(t or "")), (t or "").encode()) for i, t in texts)
    assert bpe.decode(bpe.encode(docs.limit(0), spec), spec).count() == 0
    parts = spark.createDataFrame([(1, np.array([5, 60, 7], "<u4").tobytes()), (2, None)], "doc_id long, ids binary")
    assert [bytes(r.decoded) for r in sorted(bpe.decode(parts, spec).collect())] == [other.decode_bytes([5, 60, 7]), b""]


def test_query(spark):
    d = "/root/testdata/sf0.01"
    texts, other = {r.doc_id: r.text or "" for r in registry.read(spark, d, "documents").collect()}, own(bpe.default_vocabulary())
    got = registry.op13_sentencepiece_byte_bpe(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = np.array(other.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
