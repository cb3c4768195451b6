"""Whitening and hard negatives against plain numpy over the same rows."""

import math
import random

import numpy as np
import pytest

from tallyard.llm import bit_whitening as bw
from tallyard.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, n long, words string, x double, score string, key long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", 0.5, "s", 3) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def vectors():
    """Ties, repeated rows and vectors, nulls, infinite and null entries, an empty vector and one of another length."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)], rng.randrange(3)) for i in range(330)]
    rows += [(400 + i, [0.5, -0.25, 0.125, 0.0, 0.5, 0.25], i % 2) for i in range(12)] + [rows[5], rows[100], rows[100], (100, [0.1] * 6, 1)]
    return rows + [(500, None, 1), (600, [0.5, None, 0.1, 0.1, 0.1, 0.1], 1), (601, [math.inf] * 6, 1), (602, [math.nan] * 6, 0), (700, [], 0), (None, [0.5] * 6, 1), (800, [0.5] * 6, None), (900, [0.5] * 4, 2), (901, [0.25] * 4, 2), (902, [0.4] * 4, 1)]


def finite(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


def test_scatter_is_exact():
    rng = np.random.default_rng(1)
    for rows, dims, low, high in ((1, 3, -5, 5), (63, 2, 0, 1), (64, 5, -1000, 1000), (200, 4, -(1 << 50), 1 << 50), (130, 3, 7, 8)):
        x = rng.integers(low, high, (rows, dims))
        sums, products = bw.scatter(x)
        o = x.astype(object)
        assert (sums == o.sum(axis=0)).all() and (products == o.T @ o).all()


def whitened(spark, rows):
    return bw.whiten(table(spark, rows)).collect()


def test_whitening_against_numpy(spark, vectors):
    got = whitened(spark, vectors)
    used = [r for r in vectors if finite(r[1]) and len(r[1]) == 6]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in r[1]] for r in used], object)
    n, s = len(used), x.sum(axis=0)
    assert len(got) == n * 6 and {r["n"] for r in got} == {n}
    far = n * x - s
    centred = (far / n).astype(float)
    values, base = np.linalg.eigh(centred.T @ centred / n)
    values, base = values[::-1], base[:, ::-1]
    want = centred @ base / np.sqrt(values)
    key = lambda v: (v is None, v)
    for k in range(6):
        own = [r for r in got if r["component"] == k + 1]
        assert sorted((r["vec_id"] for r in own), key=key) == sorted((r[0] for r in used), key=key)
        mine = sorted(r["whitened"] for r in own)
        assert min(np.abs(np.array(mine) - sorted(sign * want[:, k])).max() for sign in (1, -1)) < 1e-9
        assert math.isclose(own[0]["explained"], values[k] / values.sum(), rel_tol=1e-9)
    assert sorted({(r["vec_id"] or -1, r["deviation"]) for r in got}) == sorted({(u[0] or -1, int(d)) for u, d in zip(used, (far**2).sum(axis=1))})
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_without_variance_and_without_rows(spark):
    one = whitened(spark, [(1, [0.5, 0.25], 0), (1, [0.5, 0.25], 0)])
    assert len(one) == 4 and {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(0, None, None, None)}
    flat = whitened(spark, [(i, [0.5, float(i)], 0) for i in range(4)])
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat) and flat[0]["identity_error"] < 1e-9
    assert whitened(spark, [(1, None, 0)]) == [] and bw.whiten(table(spark, [])).collect() == []
    huge = whitened(spark, [(1, [1e30, 1.0], 0), (2, [-1e30, 2.0], 0), (3, [0.0, 3.0], 0)])
    assert all(r["deviation"] is None for r in huge if r["vec_id"] != 3) and huge[0]["identity_error"] < 1e-4


def test_words_hold_exact_scores():
    rng = np.random.default_rng(2)
    for dims, largest, kind in ((6, 100, np.float64), (64, 159, np.float64), (64, 1 << 20, np.int64), (8, 1 << 30, object), (3, 1 << 52, object)):
        bits = hn.layout(dims, largest)[1:]
        assert hn.layout(dims, largest)[0] is kind
        x, a = rng.integers(-largest, largest + 1, (7, dims)), rng.integers(-largest, largest + 1, (3, dims))
        x[0], a[0] = largest, -largest
        words = hn.pack(x, kind, *bits, largest)
        got = hn.scores(a, words, x.astype(object).sum(axis=1) if kind is object else x.sum(axis=1), *bits, largest)
        want = np.clip(a.astype(object) @ x.T.astype(object), -hn.MOST_SCORE, hn.MOST_SCORE)
        assert (got == want).all()


def brute(rows):
    rows = [(i, [math.floor(256 * float(np.float32(c))) for c in v], y) for i, v, y in rows if i is not None and y is not None and finite(v)]
    out = []
    for i, v, y in {(i, tuple(v), y) for i, v, y in rows if i % 100 == 0}:
        scored = sorted((max(-hn.MOST_SCORE, min(hn.MOST_SCORE, -sum(p * q for p, q in zip(v, w)))), j, z) for j, w, z in rows if j != i and len(w) == len(v))
        for s, j, _ in [t for t in scored if t[2] == y][:5]:
            for rank, (m, k, _) in enumerate([t for t in scored if t[2] != y and 80 * -s <= 100 * -t[0] <= 100 * -s][:5], 1):
                out.append((i, j, rank, k, -s, -m))
    return sorted(out)


@pytest.mark.parametrize("chunk,block", [(4096, 2048), (16, 2)])
def test_hard_negatives_against_brute_force(spark, vectors, chunk, block, monkeypatch):
    monkeypatch.setattr(hn, "CHUNK", chunk)
    monkeypatch.setattr(hn, "BLOCK", block)
    got = sorted(map(tuple, hn.hard_negatives(table(spark, vectors)).collect()))
    assert got == brute(vectors) and len(got) > 20


def test_hard_negatives_of_huge_and_of_no_rows(spark):
    rows = [(0, [3e6, 1.0], 0), (1, [2e6, 1.0], 0), (2, [1.9e6, 2.0], 1), (3, [1.5e6, 0.0], 2), (100, [-2e6, 1e6], 1)]
    assert sorted(map(tuple, hn.hard_negatives(table(spark, rows)).collect())) == brute(rows)
    assert hn.hard_negatives(table(spark, [])).collect() == [] and hn.hard_negatives(table(spark, [(0, [1.0], 1)])).collect() == []


def test_hard_negatives_against_sql(spark):
    import duckdb

    from tallyard.llm import queries as q

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    cur = con.execute(q.OP13_SQL)
    columns = [c[0] for c in cur.description]
    got = q.op13_hard_negatives(spark, sf)
    assert got.columns == columns and sorted(map(tuple, got.collect())) == sorted(cur.fetchall())
