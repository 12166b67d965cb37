"""Words, lines and pieces that a polynomial modulo a power of two can't tell apart, through every operator that hashes."""

import collections
import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tessera.llm")
from tessera.llm import bpe, kneser_ney, near_dedup, packing, quality_rules, substring  # noqa: E402
from tessera.llm import textvec as V  # noqa: E402


def thue_morse(n, one="a", two="b"):
    word = "".join((one, two)[bin(i).count("1") % 2] for i in range(n))
    return word, "".join(two if c == one else one for c in word)


PAIRS = [thue_morse(1024), thue_morse(4096), thue_morse(1024, "é", "ü"), thue_morse(4096, "日", "本")]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_segments_have_hashes_of_their_own():
    words = [w for p in PAIRS for w in p] + ["a" * n for n in range(1, 70)] + ["a" * n + "b" for n in range(1, 70)]
    block = next(V.blocks(pa.array([" ".join(words)])))
    assert len(set(V.words(block).hash.tolist())) == len(words)
    for k in (32, 35, 64):
        for a, b in PAIRS[:2]:
            x, y = (np.array([ord(c) for c in w], np.uint64) for w in (a[:k], b[:k]))
            assert V.windows(x, k) != V.windows(y, k)


def test_equal_segments_compares_bytes():
    r = np.random.default_rng(3)
    a = r.integers(0, 3, 5000).astype(np.uint8)
    b = a.copy()
    b[r.integers(0, 5000, 40)] ^= 1
    start = r.integers(0, 4800, 400)
    size = r.integers(0, 200, 400)
    want = [bool((a[i : i + n] == b[i : i + n]).all()) for i, n in zip(start, size, strict=True)]
    assert V.equal_segments(a, start, b, start, size).tolist() == want and len(set(want)) == 2


def test_encoders(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary_path())
    texts = [w for p in PAIRS for w in p]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(table(spark, texts)).collect()}
    packed = collections.Counter({r.doc_id: r.doc_tokens for r in packing.pack(table(spark, texts)).collect()})
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, np.uint32).tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        assert packed[i] == len(ids) + 1
        assert packing._encoder(bpe.vocabulary_path()).encode(t).tolist() == ids


def test_pieces_that_share_a_hash(monkeypatch):
    from tokenizers import Tokenizer

    library, real = Tokenizer.from_file(bpe.vocabulary_path()), V.segment_hash
    monkeypatch.setattr(V, "segment_hash", lambda data, start, end: real(data, start, end) % np.uint64(50))
    codec = bpe.Codec(bpe.vocabulary_path())
    texts = [f"number {i} of the many words, {i * 7919} — süß" for i in range(300)]
    for t in texts * 2:
        assert codec.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_near_duplicates_and_passages(spark):
    words = [w for p in PAIRS for w in p]
    n = len(words)
    got = near_dedup.near_duplicates(table(spark, [*words, *words]), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i % n for i in range(2 * n)}
    around = [[" ".join(f"{x}{j}-{i}" for i in range(20)) for x in "wv"] for j in range(len(PAIRS))]
    got = substring.repeated_passages(table(spark, [f"{around[i // 2][0]} {w} {around[i // 2][1]}" for i, w in enumerate(words)])).collect()
    assert {r.n_removed for r in got} == {0}


@pytest.mark.parametrize("bits", [3, 10])
def test_passages_with_windows_that_share_a_hash(spark, data, bits):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = {tuple(r) for r in substring.repeated_passages(docs, 6).drop("spans").collect()}
    assert {tuple(r) for r in substring.repeated_passages(docs, 6, bits).drop("spans").collect()} == want


def test_language_model_and_rules(spark):
    for a, b in PAIRS[:2]:
        model = kneser_ney.train(table(spark, [a]))
        got = {r.doc_id: r for r in kneser_ney.score(table(spark, [a, b]), model).collect()}
        assert (got[0].n_known, got[1].n_known) == (2, 1)
        assert math.isclose(got[1].base_score, math.log10(0.1 / 2.3) + math.log10(1.1 / 2.3))
        twice = f"{a} x\n{b} x\n{a} x"
        rows = quality_rules.quality_rules(table(spark, [f"{a}\n{b}", twice]).selectExpr("*", "'en' as lang")).collect()
        assert sorted(r.n_dup_lines for r in rows) == [0, 1]
        seven = " ".join("1234567")
        rows = quality_rules.quality_rules(table(spark, [f"{seven} {a} {seven} {b}"]).selectExpr("*", "'en' as lang")).collect()
        assert rows[0].n_repeat_words == 0
