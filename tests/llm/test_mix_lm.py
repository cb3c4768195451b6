import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyard.llm import gated_lm as g
from tallyard.llm import mixing as m


def brute_targets(sizes):
    """Shares by weight; what a source cannot take is shared anew by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= full
    return target


def check(d, near):
    rows = m.cube_mix(d).join(d.select("doc_id", "source").distinct(), "doc_id").collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    want, taken = brute_targets(sizes), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= near * max(want[s], 1) for s in want)
    return rows


def test_real_mix_is_near_and_repeatable(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted(map(tuple, check(d, 0.005))) == sorted(map(tuple, check(d.repartition(7), 0.005)))


def test_hot_source_in_many_blocks(spark):
    rows = [(k, "w " * (1 + k * 7919 % 97), "hot" if k % 3 else f"s{k % 7}") for k in range(6000)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), 0.002)


def test_repeated_and_null_ids_are_spread_and_taken_to_target(spark):
    rows = [(None, "w " * (1 + k % 50), "hot") for k in range(3000)] + [(9, "q " * (k % 40), "hot") for k in range(2000)] + [(4, "same text", "b")] * 1500 + [(k, "z " * 30, "c") for k in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    out = m.cube_mix(d).collect()
    assert len(out) == len(rows)
    target = {r["source_size"]: r["target"] for r in out}
    taken = Counter()
    for r in out:
        taken[r["source_size"]] += r["taken"]
    assert all(abs(taken[k] - t) <= 0.01 * t for k, t in target.items())
    copies = Counter(m.mixed(d).select("source").toPandas()["source"])
    words = Counter()
    for r in m.mixed(d).collect():
        words[r["source"]] += len((r["text"] or "").split())
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "hot b c".split()}
    want = brute_targets(sizes)
    assert all(abs(words[s] - want[s]) <= 0.01 * want[s] for s in want) and sum(copies.values()) > 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    s = rng.integers(1, 1000, 400).tolist()
    p = rng.uniform(0.1, 0.9, 400).tolist()
    before = sum(p), sum(a * b for a, b in zip(p, s))
    m.flight(p, s, "seed", 2)
    assert sum(0 < x < 1 for x in p) <= 2
    assert abs(sum(p) - before[0]) < 1e-6 and abs(sum(a * b for a, b in zip(p, s)) - before[1]) < 1e-3


def test_mix_edge_cases(docs, empty):
    out = m.cube_mix(docs)
    assert out.count() == docs.count() and out.filter("taken > 2 * size").count() == 0
    assert m.mixed(docs).columns == docs.columns and m.cube_mix(empty).count() == 0 and m.mixed(empty).count() == 0


def brute_base(rows, scores):
    import zlib

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t in rows:
        if not held(i):
            counts.update(g.words((t or "").encode()))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in rows:
        w = g.words((t or "").encode())
        want[i, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 4)] += 1
    assert want == Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in scores)


def test_base_score_against_brute_force(docs, rows):
    brute_base([(r[0], r[1]) for r in rows], g.lm_scores(docs, top=50).collect())


def test_model_is_a_distribution_and_beats_the_base(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = g.lm_scores(d)
    r = out.filter("held_out").agg(F.avg((F.col("score") > F.col("base_score")).cast("double")), F.max("score")).first()
    assert r[0] > 0.9 and r[1] < 0


def test_probabilities_sum_to_one():
    top = [(f"w{k}".encode(), 1000 - k) for k in range(900)]
    v = g.Vocabulary(top, sum(n for _, n in top) + 300, 1000)
    w = v.weights()
    rng = np.random.default_rng(0)
    w["class_w"] = rng.normal(size=w["class_w"].shape).astype(np.float32)
    w["member_w"] = rng.normal(size=w["member_w"].shape).astype(np.float32)
    start = np.array([3, 700], np.int32)
    base = g.likelihoods([start], v, w)[0]
    p = [math.exp(g.likelihoods([np.append(start, k).astype(np.int32)], v, w)[0] - base) for k in range(901)]
    assert abs(sum(p) - 1) < 1e-3  # the last is the whole mass of the tokens outside the top


def test_gradients_are_finite_differences():
    rng = np.random.default_rng(3)
    top = [(f"w{k}".encode(), 900 - k) for k in range(700)] + [(g.END, 100)]
    v = g.Vocabulary(top, sum(n for _, n in top) + 300, 900)
    w = {k: x.astype(np.float64) for k, x in v.weights().items()}
    for k in ("class_w", "member_w"):
        w[k] = rng.normal(0, 0.5, w[k].shape)
    part = rng.integers(0, 702, (6, 9))
    part[2, ::3] = 700  # an end token: the state starts anew
    state = rng.normal(size=(9, g.HIDDEN))
    loss, grads, _ = g.gradients(part, state, v, w)
    for key, grad in grads.items():
        for at in map(tuple, np.argwhere(np.abs(grad) > 1e-3)[:: max(1, (np.abs(grad) > 1e-3).sum() // 12)]):
            sides = []
            for step in (1e-5, -1e-5):
                moved = {k: x.copy() for k, x in w.items()}
                moved[key][at] += step
                sides.append(g.gradients(part, state, v, moved)[0])
            assert math.isclose((sides[0] - sides[1]) / 2e-5, grad[at], rel_tol=1e-4, abs_tol=1e-6), (key, at)


def test_a_gate_is_one_block_of_memory():
    """advance takes a column for each document and gives what the unit's equations give, far values too, without warnings."""
    rng = np.random.default_rng(5)
    H, n = g.HIDDEN, 7
    w, x, h = {"turn": rng.normal(size=(H, 3 * H))}, rng.normal(0, 3, (3 * H, n)), rng.normal(size=(H, n))
    x[0], x[H], x[2 * H] = -2000, 2000, -2000
    a = w["turn"].T @ h
    s = lambda v: 0.5 * np.tanh(0.5 * v) + 0.5
    z, r = s(x[:H] + a[:H]), s(x[H : 2 * H] + a[H : 2 * H])
    m = np.tanh(x[2 * H :] + r * a[2 * H :])
    with np.errstate(all="raise", under="ignore"):
        after, (*kept, am) = g.advance(w, x.copy(), h)
    assert np.allclose(after, m + z * (h - m)) and all(np.allclose(u, v) for u, v in zip([*kept, am], [z, r, m, a[2 * H :]]))
    assert all(v.flags.c_contiguous for v in kept)


def test_softmax_of_rows_far_apart():
    x = np.array([[0.0, 1.0], [-500.0, -501.0], [300.0, 0.0]])
    want = np.exp(x - np.logaddexp.reduce(x, 1)[:, None])
    p, norm = g.softmax(x.copy())
    assert np.allclose(p, want) and np.allclose(norm, np.logaddexp.reduce(x, 1))


def test_tokens_are_the_words():
    import pyarrow as pa

    texts = ["A b\x0bc  É\u00a0x", None, "", " \t\n", "b B b zz"]
    for top in ([(b"b", 9)], [(b"b", 9), (g.END, 5)]):
        v = g.Vocabulary(top, 30, 8)
        ids, rare = v.coded(pa.array(texts))
        for text, x, r in zip(texts, ids, rare.to_pylist()):
            words = g.words((text or "").encode())
            assert x.tolist() == v.ids(words).tolist()
            assert {p["token"]: p["n"] for p in r} == Counter(w for w in words if w not in v.rank)


def test_state_is_carried():
    docs = [np.array([0, 1, 2, 3] * 200, np.int32) for _ in range(6)]
    v = g.Vocabulary([(f"w{k}".encode(), 1200) for k in range(4)], 4800, 4)
    w = v.weights()
    before = g.likelihoods(docs, v, w).sum()
    for k in range(20):
        w = g.train(docs, v, w, k)
    assert g.likelihoods(docs, v, w).sum() > 0.5 * before
    alone = [g.likelihoods([x], v, w)[0] for x in (docs[0], docs[0][:70])]
    assert np.allclose(g.likelihoods([docs[0][:70], docs[0]], v, w), alone[::-1], rtol=1e-5)


def test_every_training_document_is_learned(spark):
    """However large the corpus: the vocabulary says that it has a thousand million tokens."""
    top = [(f"w{k}".encode(), 10**7) for k in range(100)]
    v = g.Vocabulary(top, 10**9, 100)
    text = lambda k: " ".join(f"w{(k * 7 + i * i) % 100}" for i in range(60))
    rows = [(k if k % 3 else None, text(k)) for k in range(30)]
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    whole = g.pack(g.learn(frame(rows), v))
    assert all(g.pack(g.learn(frame(rows[:k] + rows[k + 1 :]), v)) != whole for k in (0, 1, 29))
    dealt = g.dealt_rows(frame(rows), v).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["ids"])) for r in dealt) == sorted((k or 0, v.ids(g.words(t.encode())).tobytes()) for k, t in rows)
    assert len({r["shard"] for r in dealt if r["doc_id"] is None}) > 5


def test_no_token_is_left_at_the_end():
    v = g.Vocabulary([(b"a", 10), (b"b", 10)], 20, 2)
    a, b = (g.train([np.array([0] * 1500 + [k], np.int32)], v, v.weights(), 0) for k in (0, 1))
    assert any((a[k] != b[k]).any() for k in a)


def test_lm_edge_cases(empty):
    assert g.lm_scores(empty).count() == 0
