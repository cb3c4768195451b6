import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tallyard.llm import byte_bpe as b
from tallyard.llm import token_files as t

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.mark.parametrize("chunk, overlap, local", [(b.CHUNK, b.OVERLAP, b.LOCAL), (b.CHUNK, b.OVERLAP, 1), (500, 40, 4), (64, 16, 1), (64, 16, 1000)])
def test_bpe_against_the_library(docs, rows, chunk, overlap, local):
    enc = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=b.read_ranks(RANKS), special_tokens={})
    want = []
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = [tuple(r) for r in b.bpe_documents(docs, RANKS, P.PATTERN, chunk, overlap, local).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stitching_resynchronises():
    bpe = b.ByteBpe(RANKS, P.PATTERN)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", " ", "   ", "\n", "12", "'s", "é", "!!", " the ", "zzzzzzzzz"]) for _ in range(rng.randint(1, 90)))
        for chunk, overlap in ((16, 8), (10, 3)):
            parts = b.cut(text, chunk, overlap)
            coded = [(at, x, *b.chunk_tokens(bpe, at, x, k == len(parts) - 1)) for k, (at, x) in enumerate(parts)]
            assert b.stitch(bpe, coded) == bpe.encode(text)
            assert bpe.encode(text, 7, 2) == bpe.encode(text)
            assert bpe.decode(bpe.encode(text)) == text.encode()


def test_merges_against_the_library():
    bpe = b.ByteBpe(RANKS, P.PATTERN)
    lib = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=b.read_ranks(RANKS), special_tokens={})
    rng = random.Random(8)
    for k in range(3000):
        text = "".join(rng.choice(["a", "ing", "é", "日", "\U0001f600", "er", "xq", "\u0301", "the", "Z"]) for _ in range(rng.randint(1, 6 if k % 3 else 60)))
        assert [i for p in bpe.pieces(text) for i in b.merged(bpe.ranks, p.encode())] == lib.encode_ordinary(text)


def test_runs_without_a_boundary_take_linear_time():
    bpe = b.ByteBpe(RANKS, P.PATTERN)
    sizes = []

    class Counted:
        def findall(self, text):
            sizes.append(len(text))
            return pattern.findall(text)

    pattern, bpe.pattern = bpe.pattern, Counted()
    text = "ab " * 900 + "a" * 300_000 + " b c" * 900
    ids = bpe.encode(text)
    assert sum(sizes) < 5 * len(text) and bpe.decode(ids) == text.encode()
    assert ids == bpe.encode(text, len(text))


def test_token_files_against_the_library(docs, rows):
    lib = Tokenizer.from_file(WORDS)
    at, want = 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [tuple(r) for r in t.token_files(docs, WORDS).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_texts_with_added_tokens_against_the_library():
    lib, own = Tokenizer.from_file(WORDS), t.WordEncoder(WORDS)
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endoftext|", "a", " ", "  ", "Don't", "<|", "|>", "é", "12", "\n", "İ", "!!", "日本"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    for at in range(0, len(texts), 50):
        some = texts[at : at + 50]
        want = [np.array(lib.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in some]
        assert own.encode([x.encode() for x in some]) == want


def test_many_rows_of_one_id_take_their_places_in_order(spark):
    rows = [(7, f"w{k} x") for k in range(300)] + [(None, f"n{k}") for k in range(100)] + [(3, "a")] * 5
    got = sorted(t.token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), WORDS).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 100 + [3] * 5 + [7] * 300
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:]))


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 127, 128, 129, 5000):
        for high in (1, 300, 49408, 2**32 - 1):
            ids = rng.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
            ids[rng.integers(0, max(n, 1), n // 50)] = 2**32 - 1
            image = t.pack_segment(ids)
            assert (t.unpack_segment(image) == ids).all()
            for k in range(-(-n // 128)):
                assert (t.unpack_block(image, k) == ids[k * 128 : (k + 1) * 128]).all()


def test_outliers_go_to_exceptions():
    ids = np.full(1280, 7, np.uint32)
    ids[5::128] = 4_000_000_000
    assert len(t.pack_segment(ids)) < 12 + 10 * (4 + 6 + 5 + 1)


def test_empty_tables(empty):
    assert b.bpe_documents(empty, RANKS, P.PATTERN).count() == 0 and t.token_files(empty, WORDS).count() == 0
