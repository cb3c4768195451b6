import corpus_pipeline as p


def test_stages_chain_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = p.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = [r["doc_id"] for r in out.collect()]
    assert 0 < len(set(ids)) < docs.count() and max(map(ids.count, set(ids))) == 2
    kept = p.near(spark, p.exact(spark, p.quality(spark, docs, sf), sf), sf)
    assert kept.columns == docs.columns and set(ids) <= {r["doc_id"] for r in kept.collect()}


def test_registered():
    import __spark_entry__ as e

    q = e.queries()
    assert q["pipeline"] is p.run and all(any(n.startswith(f"op{k}_") for n in q) for k in range(1, 14))
    assert set(e.oracle_sql()) <= set(q)


SF = "/root/testdata/sf0.001"


def bare(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def test_stages_on_hostile_rows(spark, docs, rows):
    """Each stage against a brute-force version over nulls, empty and long texts, ties, repeated rows and clashing columns."""
    kept = p.quality(spark, docs, SF)
    assert kept.columns == docs.columns
    enough = {r[0] for r in rows if len((r[1] or "").split()) >= 50}
    assert {r["doc_id"] for r in kept.collect()} <= enough
    exact = p.exact(spark, docs, SF)
    assert exact.columns == docs.columns
    groups = {}
    for r in rows:
        groups.setdefault(bare(r[1]), []).append(r)
    want = {min(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0] for g in groups.values()}
    assert {r["doc_id"] for r in exact.collect()} == want and exact.count() == len(groups)
    near = p.near(spark, exact, SF)
    assert near.columns == docs.columns
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {r["doc_id"]: (r["text"] or "").translate(low).replace("\x0b", " ").replace("\x0c", " ") for r in exact.collect()}
    words = {k: [w for w in "".join(c if c not in "\t\n\r" else " " for c in t).split(" ") if w] for k, t in texts.items()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in words.items()}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted((k for k in sets if k is not None))
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in near.collect() if r["doc_id"] is not None} == {k for k in ids if find(k) == k}
    mixed = p.mixing(spark, near, SF)
    assert mixed.columns == docs.columns
    drawn = [r["doc_id"] for r in mixed.collect()]
    assert max(map(drawn.count, drawn)) <= 2 and set(drawn) <= {r["doc_id"] for r in near.collect()}
    import hashlib

    shown = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in near.collect()}
    for r in p.tokens(spark, near, SF).collect():
        assert r["decoded_sha256"] == shown[r["doc_id"]]


def test_stages_on_an_empty_table(spark, empty):
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0
