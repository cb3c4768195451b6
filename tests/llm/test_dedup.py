import hashlib
import itertools
import random
import re
from collections import defaultdict

import pytest

from tallyard.llm import exact_dedup as x
from tallyard.llm import near_dedup as nd
from tallyard.llm.components import components

WS = re.compile(r"[\x20\x09-\x0D]+")


def test_exact_against_brute_force(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[WS.sub("", r[1] or "")].append(r)
    want = []
    for content, rs in groups.items():
        best = min(rs, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0]
        want += [(r[0], best, len(rs), r[0] == best, hashlib.sha256(content.encode()).hexdigest()) for r in rs]
    got = [tuple(r) for r in x.exact_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_grace_spills_and_merges(tmp_path):
    records = [(f"text {k % 700} {'y' * (k % 700)}".encode(), 1, k % 700, k) for k in range(5000)]
    got = {c: (n, i) for c, n, _, i in x.grace(records, 20_000, str(tmp_path))}
    assert len(got) == 700 and all(n == 5000 // 700 + (int(c.split()[1]) < 5000 % 700) and i == int(c.split()[1]) for c, (n, i) in got.items())
    assert not list(tmp_path.iterdir())


def test_one_content_larger_than_memory(tmp_path):
    got = list(x.grace([(b"z" * 5000, 1, 5000, k) for k in range(50)], 1000, str(tmp_path)))
    assert got == [(b"z" * 5000, 50, 5000, 0)]


def test_deduplicate_keeps_columns(docs, rows, empty):
    kept = x.deduplicate(docs, memory=10_000)
    assert kept.columns == docs.columns
    assert kept.count() == len({WS.sub("", r[1] or "") for r in rows})
    assert x.exact_dedup(empty).count() == 0 and x.deduplicate(empty).count() == 0


def test_deduplicate_leaves_one_row_of_each_content(spark):
    rows = [(5, "t"), (5, "t"), (None, "x"), (None, "x "), (None, "x"), (6, "t"), (7, None), (7, ""), (8, " y"), (8, "y")]
    kept = x.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 4 and (5, "t") in kept and (None, "x ") in kept


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())


def brute_components(rows):
    """doc_id -> smallest doc_id reachable; rows that repeat an id are one node with the links of all their texts."""
    sets = sorted({(r[0], shingle_set(r[1])) for r in rows if r[0] is not None}, key=lambda x: (x[0], sorted(x[1])))
    up = {d: d for d, _ in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            p, q = sorted((find(a), find(b)))
            up[q] = p
    return {d: find(d) for d in up}


def test_near_against_brute_force(docs, rows):
    sizes = defaultdict(set)
    for r in rows:
        sizes[r[0]].add(len(shingle_set(r[1])))
    comp = brute_components(rows)
    for r in nd.near_dedup(docs).collect():
        assert r["n_shingles"] in sizes[r["doc_id"]]
        assert r["component_id"] == comp.get(r["doc_id"]) and r["kept"] == (r["component_id"] == r["doc_id"])
    assert len(set(comp.values())) < len(comp) - 10


def test_near_on_real_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    comp = brute_components([(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()])
    assert {r["doc_id"]: r["component_id"] for r in nd.near_dedup(d).collect()} == comp


@pytest.mark.parametrize("order", [1, -1])
def test_near_keeps_all_links_of_repeated_ids(spark, order):
    text = lambda k, n=60: " ".join(f"{k}w{i}" for i in range(n))
    rows = [(5, text("a")), (5, text("b")), (7, text("b") + " x"), (9, text("a") + " y"), (3, text("c")), (9, text("c")), (8, text("d")), (8, text("e")), (6, text("e")), (6, text("d") + " z"), (5, text("a"))]
    rows += [(10 + k, text("f")) for k in range(3)] + [(12, text("g")), (11, text("h")), (20, text("h")), (2, text("g") + " q")]
    got = nd.near_dedup(spark.createDataFrame(rows[::order], "doc_id long, text string").coalesce(1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(rows)
    assert len(got) == len(rows)
    kept = nd.deduplicate_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(brute_components(rows).values()))


def test_large_groups_lose_no_link(spark, monkeypatch):
    """Blocks of few members, so that hubs, blocks of one component and shared blocks all occur."""
    rng = random.Random(4)
    monkeypatch.setattr(nd, "BLOCK", 8)
    monkeypatch.setattr(nd, "FAMILY_BLOCK", 6)
    monkeypatch.setattr(nd, "HUBS", 2)
    rows = []
    for family in range(4):
        base = [f"{family}w{i}" for i in range(80)]
        for _ in range(60):
            words = base[:]
            for _ in range(rng.choice((0, 1, 2, 3, 4))):
                words[rng.randrange(80)] = f"e{rng.randrange(6)}"
            rows.append((len(rows) * 7 % 251, " ".join(words)))
    comp = brute_components(rows)
    assert 4 < len(set(comp.values())) < 200
    got = {r["doc_id"]: r["component_id"] for r in nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == comp


def test_near_families_larger_than_a_block(spark):
    base = [f"w{k}" for k in range(90)]
    texts = [" ".join(base[:k % 80] + [f"e{k}"] + base[k % 80 + 1 :]) for k in range(600)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = nd.near_dedup(d)
    assert [r[0] for r in out.select("component_id").distinct().collect()] == [0] and out.filter("kept").count() == 1


def test_near_empty(empty, docs):
    assert nd.near_dedup(empty).count() == 0 and nd.deduplicate_near(empty).count() == 0
    assert nd.deduplicate_near(docs).columns == docs.columns


def test_bayes_bound_is_loose_enough():
    bounds = nd.least_agreements()
    assert all(b <= 0.75 * n for b, n in zip(bounds, range(16, 129, 16))) and bounds[-1] > 64


@pytest.mark.parametrize("n", [2, 50])
def test_components_of_a_path(spark, n):
    edges = spark.createDataFrame([(k + 1, k) for k in range(10, 10 + n)] + [(5, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {k: 10 for k in range(10, 11 + n)} | {3: 3, 5: 3}


def test_components_of_small_tables_take_few_jobs(spark):
    """A table that fits one task needs no rounds, each of which shuffles and writes the edges several times."""
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(90, 7), (90, 80), (80, 90)], "u long, v long")
    spark.sparkContext.setJobGroup("few-jobs", "components")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == dict.fromkeys([*range(41), 80, 90], 0)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) <= 6


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_several_tasks(spark, monkeypatch, seed):
    """Forests that are flushed, tables of several tasks and the rounds after them."""
    import tallyard.llm.components as module

    monkeypatch.setattr(module, "contracted", with_little_memory(module.contracted))
    monkeypatch.setattr(module, "HELD", 12)
    rng = random.Random(seed)
    pairs = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(300 + k, 301 + k) for k in range(40)]
    up = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in range(len(up)):
        for a, b in pairs:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    got = components(spark.createDataFrame(pairs, "u long, v long").repartition(4)).collect()
    assert len(got) == len(up) and {r["node"]: r["component"] for r in got} == up


def with_little_memory(contracted):
    """contracted in workers, which do not see the test's settings: a forest of few nodes, fed edge by edge."""

    def run(batches):
        import tallyard.llm.components as module

        before, module.HELD = module.HELD, 3
        try:
            yield from contracted(batch.slice(k, 1) for batch in batches for k in range(batch.num_rows))
        finally:
            module.HELD = before

    return run


def test_bucket_signatures_keep_every_agreement():
    """8 bits of each minimum go to the buckets: whatever agreed still agrees."""
    rng = random.Random(3)
    sets = [nd.np.array(sorted(rng.sample(range(1 << 60), 80)), nd.np.uint64) for _ in range(40)]
    whole = [nd.signature(s) for s in sets + [s[:70] for s in sets]]
    batch = nd.pa.RecordBatch.from_pydict({"rep": list(range(80)), "sig": [w.tobytes() for w in whole]})
    [out] = nd.low_bytes([batch])
    short = [nd.np.frombuffer(x, nd.np.uint8) for x in out.column("sig").to_pylist()]
    assert all(len(s) == nd.PERMUTATIONS and (s == w % 256).all() for s, w in zip(short, whole))
    bounds = nd.least_agreements()
    alive = lambda sig: set(nd.survivors(nd.np.stack(sig[:40]), nd.np.stack(sig[40:]), bounds).tolist())
    assert alive(whole) <= alive(short) and len(alive(whole)) == 40
