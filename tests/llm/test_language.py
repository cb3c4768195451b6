"""The chain of languages against sums over all labellings, gradients of its windows, held-out accuracy and edge cases."""

import itertools
import zlib

import numpy as np

from tallyard.llm import lang_crf as lc

SF = "/root/testdata/sf0.01"


def field(states, seed=1):
    rng = np.random.default_rng(seed)
    grams = rng.normal(0, 1, (lc.HASHES + 1, states)).astype(np.float32)
    grams[-1] = 0
    return lc.LanguageField(list("abcdef"[:states]), grams, np.zeros(0, np.uint64), np.zeros((1, states), np.float32), rng.normal(0, 1, (states, states)).astype(np.float32))


def test_posteriors_against_all_labellings(monkeypatch):
    monkeypatch.setattr(lc, "CHAIN", 2)  # windows of two words: their transfer matrices are joined
    f = field(3)
    e = np.random.default_rng(2).normal(0, 2, (12, 3)).astype(np.float32)
    counts = np.array([6, 0, 1, 5])
    got, at = f.chain(e, counts), 0
    for n in counts:
        want = np.zeros((n, 3))
        for ys in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(e[at + t, y] for t, y in enumerate(ys)) + sum(f.moves[a, b] for a, b in zip(ys, ys[1:])))
            for t, y in enumerate(ys):
                want[t, y] += p
        assert n == 0 or np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True), atol=1e-6)
        at += n


def test_windows_do_not_change_posteriors(monkeypatch):
    f, e = field(4), np.random.default_rng(3).normal(0, 2, (1000, 4)).astype(np.float32)
    counts = np.array([700, 1, 299])
    want = f.chain(e, counts)
    monkeypatch.setattr(lc, "CHAIN", 5)
    assert np.allclose(f.chain(e, counts), want, atol=1e-6)


def test_features_stay_inside_words():
    f = field(2)
    apart = [f.emissions(b" " + w + b" ")[0] for w in (b"abc", b"x", b"\xc3\xa9tat", b"a" * 200)]
    together = f.emissions(b"  abc x   \xc3\xa9tat " + b"a" * 200 + b"  ")
    assert np.allclose(together, apart, atol=1e-3)


def test_pieces_do_not_change_totals(monkeypatch):
    f = field(3)
    texts = [lc.letters_of(t) for t in ("one two three four", "", "fünf!! sechs 7 sieben", "x" * 90 + " y", "a b c d e f g")]
    want = f.totals(texts)
    monkeypatch.setattr(lc, "PIECE", 95)
    assert np.allclose(f.totals(texts), want, atol=1e-6)
    monkeypatch.setattr(lc, "PIECE", 20)  # the long word counts as several, the others keep their texts
    some = f.totals(texts)
    assert np.allclose(some[[0, 2, 4]], want[[0, 2, 4]], atol=1e-6) and some[3].sum() > want[3].sum()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lc.fit_languages(docs)
    got = {r["doc_id"]: r for r in lc.language_ids(docs, model).collect()}
    rows = docs.select("doc_id", "lang", "text").collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]]["held_out"] for r in held) and sum(g["held_out"] for g in got.values()) == len(held)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.98
    by = {}
    for r in rows:
        if r["lang"] and r["text"] and len(r["text"]) > 400:
            by.setdefault(r["lang"], r["text"])
    a, b = (" ".join(by[k].split()[:25]) for k in sorted(by)[:2])
    [labels] = [r["langs"] for r in lc.label_words(spark.createDataFrame([(1, a + " " + b)], "doc_id long, text string"), model).collect()]
    n = len(lc.letters_of(a).split())
    right = labels[:n].count(sorted(by)[0]) + labels[n:].count(sorted(by)[1])
    assert right > 0.85 * len(labels)


def test_edges(spark, docs, empty):
    model = lc.fit_languages(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = {}
    for r in lc.language_ids(docs, model).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(sum(got.values(), [])) == docs.count() and got[None][0]["held_out"] is False
    for r in docs.collect():
        g = got[r["doc_id"]][0]
        bare = not r["text"] or not any(c.isalpha() for c in r["text"])
        assert (g["lang_pred"] == "und") == bare and 0 <= g["score"] <= 1 and (g["score"] > 0) == (not bare)
    assert lc.language_ids(empty, model).collect() == [] and lc.fit_languages(empty) is None
    assert {r["lang_pred"] for r in lc.language_ids(docs, None).collect()} == {"und"}
