"""MinHash near-deduplication with sequential Bayesian verification.

A document is the set of its distinct five-word shingles (A-Z lower-cased; a shorter text is one shingle).
Two documents are linked when 100 |A and B| >= 75 |A or B|.

1. Each text gives a 128-bit digest of its set and PERMUTATIONS minimum hashes.  Equal sets are one class, whose
   node is its smallest doc_id, however many copies there are.
2. BANDS bands of ROWS hashes propose candidates: classes that agree on a band share a bucket.
   A pair of similarity 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6.
3. In each bucket signatures (8 bits of each minimum; step 4 has 16) are compared batch by batch: after n hashes with m agreements the posterior
   probability of a similarity of 0.75 or more (uniform prior: a binomial tail) is compared with MISS, and the pair is
   dropped below it.  The surviving pairs join the classes into families.
4. The families' documents are read once more; pairs in a family that pass the Bayesian bound are verified exactly on the
   full sets.
5. Components of the links give component_id, the smallest doc_id.

Steps 3 and 4 share one scheme (``settle``).  A group of at most a block is compared in one place.  Of a larger one, every member
is first compared with HUBS members drawn by hash, block by block, so that each is sent once; components of what that
joins then say which members still have to meet: pairs of blocks that hold different components.  Copies of one template are
joined by the hubs, and the few strays that no hub joins are sent to the others' blocks, so no pair is left out and a
group of n near copies costs n rows.  Only members that are candidates of each other but not linked meet pairwise.

Shingles are 64-bit hashes built from the words' 64-bit hashes, so sets are exact but for collisions of 2^-64.

Defined cases: a null or empty text has an empty set and is linked with nothing; a null doc_id is linked with nothing
(component_id null, kept); rows that repeat a doc_id are one node and link all that any of their texts is
linked with; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, slices, stored, texts, worker_cache
from .components import components

SHINGLE = 5
PERMUTATIONS = 128
BANDS, ROWS = 32, 4
BLOCK = 256
FAMILY_BLOCK = 64
HUBS = 6
BATCH = 16
MISS = 1e-7
LEAST, OF = 75, 100

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


ODD = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
SEEDS = mix(np.arange(1000, 1000 + PERMUTATIONS, dtype=np.uint64))
XOR, TIMES = (SEEDS >> np.uint64(32)).astype(np.uint32), SEEDS.astype(np.uint32) | np.uint32(1)


def shingles(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct shingles."""
    words = text.translate(LOWER).split()
    if len(known) > 400_000:
        known.clear()
    try:
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    if len(h) < SHINGLE:
        return mix(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64))
    n = len(h) - SHINGLE + 1
    s = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        s += h[k : k + n] * ODD[k]
    return np.unique(mix(s))


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of each minimum hash."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (((x[at : at + 1024, None] ^ XOR) * TIMES)).min(0), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def least_agreements() -> list[int]:
    """For n = BATCH, 2 BATCH, ...: the fewest agreements whose posterior P(similarity >= 0.75) reaches MISS.

    With a uniform prior the posterior after m of n is Beta(m+1, n-m+1), and its upper tail at t is the
    chance of at most m successes in n+1 trials of t.
    """
    t, out = LEAST / OF, []
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        tail, m = 0.0, 0
        for m in range(n + 2):
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= MISS:
                break
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, bounds: list[int]) -> np.ndarray:
    """Which of the aligned signature pairs no batch prunes."""
    alive = np.arange(len(a))
    agree = np.zeros(len(a), np.int32)
    for k, bound in enumerate(bounds):
        part = slice(k * BATCH, (k + 1) * BATCH)
        agree = agree + (a[alive, part] == b[alive, part]).sum(1)
        keep = agree >= bound
        alive, agree = alive[keep], agree[keep]
    return alive


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def stars(self, names: np.ndarray) -> list[tuple[int, int]]:
        """Each member that is joined, with the smallest name of its tree: groups that overlap repeat these edges,
        so far fewer distinct ones leave than tree edges would."""
        least: dict[int, int] = {}
        roots = [self.find(x) for x in range(len(self.up))]
        for r, name in zip(roots, names.tolist()):
            least[r] = min(name, least.get(r, name))
        return [(name, least[r]) for r, name in zip(roots, names.tolist()) if name != least[r]]

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


WHOLE, HUB, MEMBER, LEFT, RIGHT = range(5)


def pairs(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that a task group compares, by the roles of its rows: all of WHOLE, hubs with each other and
    with members, left with right; only those of different components, where these are known (known)."""
    role, comp, known = numbers(parts, "role"), numbers(parts, "comp"), numbers(parts, "known")
    some = np.flatnonzero(role <= HUB)
    i, j = np.triu_indices(len(some), 1)
    a, b = [some[i]], [some[j]]
    for one, other in ((HUB, MEMBER), (LEFT, RIGHT)):
        x, y = np.flatnonzero(role == one), np.flatnonzero(role == other)
        a.append(np.repeat(x, len(y)))
        b.append(np.tile(y, len(x)))
    a, b = np.concatenate(a), np.concatenate(b)
    apart = (comp[a] != comp[b]) | ~known[a]
    return a[apart], b[apart]


def grouped(batches, keys: tuple[str, ...]):
    """Tables of consecutive rows that agree on keys; the input is sorted by them.  Holds one group and one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        starts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, held


def fixed(parts: list[pa.RecordBatch], name: str, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(b"".join(p.column(name).to_pylist()), dtype).reshape(p.num_rows, -1) for p in parts])


def numbers(parts: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([p.column(name).to_numpy(zero_copy_only=False) for p in parts])


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*edges) if edges else ((), ())
    out = pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
    edges.clear()
    return out


def digests(batches):
    """Per document: size and digest of its set, signature."""
    known = worker_cache("shingle_words")
    for batch in slices(batches):
        rows = []
        for text in texts(batch):
            s = shingles(text, known)
            d = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else bytes(16)
            rows.append((len(s), *np.frombuffer(d, "<i8").tolist(), signature(s).tobytes()))
        n, d1, d2, sig = zip(*rows) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "sig"])


def band_keys(batches):
    for batch in slices(batches, 2048):
        sig = fixed([batch], "sig", np.uint16) if batch.num_rows else np.zeros((0, PERMUTATIONS), np.uint16)
        keys = mix(np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), BANDS) + mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(7))[None])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS)), pa.array(keys.reshape(-1).view(np.int64))], names=["rep", "grp"])


def low_bytes(batches):
    """The signatures with 8 bits of each minimum: equal minima stay equal, and half as many bytes go to each bucket."""
    for batch in slices(batches, 2048):
        sig = [x.tobytes() for x in fixed([batch], "sig", np.uint16).astype(np.uint8)] if batch.num_rows else []
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sig, pa.binary())], names=["rep", "sig"])


def bucket_forest(batches):
    """The trees of the surviving pairs of each task group, as stars."""
    bounds, out = least_agreements(), []
    for _, parts in grouped(batches, KEYS):
        reps, sig = numbers(parts, "rep"), fixed(parts, "sig", np.uint8)
        a, b = pairs(parts)
        forest = Forest(len(reps))
        for at in range(0, len(a), 8192):
            x, y = a[at : at + 8192], b[at : at + 8192]
            for k in survivors(sig[x], sig[y], bounds).tolist():
                forest.join(int(x[k]), int(y[k]))
        out += forest.stars(reps)
        if len(out) > 4096:
            yield edge_batch(out)
    yield edge_batch(out)


def family_sets(batches):
    known = worker_cache("shingle_words")
    for batch in slices(batches):
        sets = [shingles(t, known) for t in texts(batch)]
        raw = [s.tobytes() for s in sets]
        digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw)), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("rep"), batch.column("members"), pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array(raw, pa.large_binary()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())], names=["grp", "rep", "members", "sig", "shingles", "d1", "d2"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if OF * min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= LEAST * (len(a) + len(b) - both)


def family_links(batches):
    """The trees of the links, verified on the full sets, of each task group, as stars."""
    bounds, out = least_agreements(), []
    for _, parts in grouped(batches, KEYS):
        reps, sig = numbers(parts, "rep"), fixed(parts, "sig", np.uint16)
        sets = [np.frombuffer(x, np.uint64) for p in parts for x in p.column("shingles").to_pylist()]
        a, b = pairs(parts)
        keep = survivors(sig[a], sig[b], bounds)
        a, b = a[keep], b[keep]
        order = np.argsort(-(sig[a] == sig[b]).sum(1), kind="stable")  # the likeliest links first
        forest = Forest(len(reps))
        for x, y in zip(a[order].tolist(), b[order].tolist()):
            if forest.find(x) != forest.find(y) and linked(sets[x], sets[y]):
                forest.join(x, y)
        out += forest.stars(reps)
        if len(out) > 4096:
            yield edge_batch(out)
    yield edge_batch(out)


KEYS = ("grp", "i", "j")
EDGES = "u long, v long"


def placed(rows: DataFrame, role, i=0, j=0, comp=None) -> DataFrame:
    """rows with the columns that say where and how they are compared."""
    at = {"i": i, "j": j, "role": role}
    rows = rows.withColumns({k: v if not isinstance(v, int) else F.lit(v) for k, v in at.items()})
    rows = rows.withColumns({"i": F.col("i").cast("long"), "j": F.col("j").cast("long"), "known": F.lit(comp is not None)})
    return rows.withColumn("comp", F.lit(0).cast("long") if comp is None else comp)


def settle(members: DataFrame, largest: int, block: int, compare, name: str) -> DataFrame:
    """Components (node, component) of the pairs that compare joins in the groups of members (grp, rep, members and more).

    members (the column): how many a row's group has, so that no join has to move the signatures or sets to learn it; largest: the most of any group.
    """
    columns = [*members.drop("members").columns, "i", "j", "role", "known", "comp"]
    run = lambda rows: rows.select(*columns).repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(compare, EDGES)
    in_one = placed(members.filter(f"members <= {block}").drop("members"), WHOLE)
    if largest <= block:
        return components(run(in_one), name)

    held = members.filter(f"members > {block}").withColumn("blocks", F.ceil(F.col("members") / block).cast("long"))
    held = stored(held.drop("members"), name + "-held")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    draws = F.array(*(F.min_by("rep", F.xxhash64("rep", F.lit(k))) for k in range(HUBS)))
    hubs = stored(held.groupBy("grp").agg(F.array_distinct(draws).alias("rep")).select("grp", F.explode("rep").alias("rep")), name + "-hubs")
    of_hub = held.join(hubs, ["grp", "rep"]).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    star = placed(of_hub, HUB, F.col("at")).select(*columns).unionByName(placed(held.join(hubs, ["grp", "rep"], "left_anti"), MEMBER, own).select(*columns))
    hubbed = components(run(in_one.select(*columns).unionByName(star)), name)
    found = hubbed.select(F.col("node").alias("rep"), "component")

    # What is left: pairs of different components.  A component of more than a block has blocks of its own (big is its name),
    # the other members of a group share blocks by hash (big is null).
    marked = stored(held.drop("blocks").join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep")), name + "-marked")
    parts = stored(marked.groupBy("grp", "component").agg(F.count("*").alias("n")), name + "-parts")
    big = F.when(F.col("n") > block, F.col("component"))
    lots = parts.groupBy("grp", big.alias("big")).agg(F.ceil(F.sum("n") / block).cast("long").alias("blocks"), F.count("*").alias("comps"))
    lots = lots.withColumn("big_key", F.xxhash64("grp", F.coalesce(F.col("big").cast("string"), F.lit("-"))))
    several = lots.groupBy("grp").agg(F.sum("comps").alias("comps"), F.collect_list(F.struct("big", "big_key", "blocks")).alias("lot")).filter("comps > 1")
    lot = F.expr("flatten(transform(lot, x -> transform(sequence(0L, x.blocks - 1), k -> struct(x.big as big, x.big_key as big_key, x.blocks as blocks, k as k))))")
    listed = several.select("grp", lot.alias("lot")).withColumn("mine", F.explode("lot"))
    meeting = listed.withColumn("other", F.explode(F.expr("filter(lot, x -> x.big is null or not x.big <=> mine.big)")))
    first = F.struct("mine.big_key", "mine.k") <= F.struct("other.big_key", "other.k")
    same = (F.col("mine.big_key") == F.col("other.big_key")) & (F.col("mine.k") == F.col("other.k"))
    meeting = meeting.select(
        "grp", F.col("mine.big_key").alias("big_key"), F.col("mine.k").alias("k"),
        F.when(same, WHOLE).when(first, LEFT).otherwise(RIGHT).alias("as"),
        F.xxhash64(F.when(first, F.col("mine.big_key")).otherwise(F.col("other.big_key")), F.when(first, F.col("mine.k")).otherwise(F.col("other.k"))).alias("one"),
        F.xxhash64(F.when(first, F.col("other.big_key")).otherwise(F.col("mine.big_key")), F.when(first, F.col("other.k")).otherwise(F.col("mine.k"))).alias("two"),
    )
    meeting = stored(meeting, name + "-meeting")
    if meeting.isEmpty():
        return hubbed
    places = parts.withColumn("big_key", F.xxhash64("grp", F.coalesce(big.cast("string"), F.lit("-")))).join(lots.select("big_key", "blocks"), "big_key").select("grp", "component", "big_key", "blocks")
    left = marked.join(stored(places, name + "-places"), ["grp", "component"]).withColumn("k", own)
    left = left.join(meeting, ["grp", "big_key", "k"])
    more = run(placed(left, F.col("as"), F.col("one"), F.col("two"), F.col("component")))
    edges = hubbed.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    return components(edges.unionByName(more), name)


def near_dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = stored(rows.mapInArrow(digests, "doc_id long, n_shingles long, d1 long, d2 long, sig binary"), "near-sets")

    real = sets.filter("n_shingles > 0 and doc_id is not null")
    classes = stored(real.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "near-classes")
    reps = real.join(classes.withColumnRenamed("rep", "doc_id"), ["d1", "d2", "doc_id"], "left_semi").dropDuplicates(["d1", "d2", "doc_id"])
    reps = stored(reps.select(F.col("doc_id").alias("rep"), "sig"), "near-reps")

    bands = reps.mapInArrow(band_keys, "rep long, grp long")
    count = F.count("*").over(Window.partitionBy("grp"))
    largest = lambda groups: groups.agg(F.coalesce(F.max("members"), F.lit(0))).first()[0]
    buckets = stored(bands.withColumn("members", count).filter("members > 1"), "near-buckets")
    short = reps.mapInArrow(low_bytes, "rep long, sig binary")
    members = buckets.join(short, "rep").select("grp", "rep", "members", "sig")
    families = settle(members, largest(buckets), BLOCK, bucket_forest, "near-families").select(F.col("node").alias("rep"), F.col("component").alias("grp"))
    families = stored(families.withColumn("members", count), "near-families")

    held = rows.join(families, rows["doc_id"] == families["rep"]).select("grp", "rep", "members", "text")
    held = held.mapInArrow(family_sets, "grp long, rep long, members long, sig binary, shingles binary, d1 long, d2 long")
    held = stored(held.dropDuplicates(["rep", "d1", "d2"]).drop("d1", "d2"), "near-held")
    links = settle(held, largest(families), FAMILY_BLOCK, family_links, "near-links")

    # A document in several classes (a repeated doc_id) is one node: the smallest ids of its classes are linked with it.
    many = real.groupBy("doc_id").agg(F.min(F.xxhash64("d1", "d2")).alias("a"), F.max(F.xxhash64("d1", "d2")).alias("b")).filter("a <> b").select("doc_id")
    of_doc = real.join(stored(many, "near-many"), "doc_id", "left_semi").select("doc_id", "d1", "d2").distinct().join(classes, ["d1", "d2"])
    least = of_doc.groupBy("doc_id").agg(F.min("rep").alias("v"))
    repeated = of_doc.join(least, "doc_id").filter("rep <> v").select(F.col("rep").alias("u"), "v")
    repeated = stored(repeated.distinct(), "near-repeated")
    if not repeated.isEmpty():
        links = components(links.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(repeated), "near-all")
    found = stored(links, "near-components")
    verdicts = classes.join(found, classes["rep"] == found["node"], "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(verdicts, ["d1", "d2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate_near(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document is the smallest id of its component, with their columns; of rows that repeat
    that id one stays, and all rows without an id."""
    found = near_dedup(docs)
    gone = found.filter("not kept").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = stored(found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "near-again")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(kept.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
