"""Mixing sources to target weights by the cube method.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 150% of all words;
a source takes at most twice its own words, and what it cannot take is shared anew by weight.  A document
of a source with ratio r = target / words is taken floor(r) times for certain and once more with
inclusion probability frac(r).

The fractional probabilities move through the null space of the two balancing constraints (document total
and word total): with three fractional documents of sizes a, b, c the direction (b-c, c-a, a-b) leaves both
totals as they are, and a step along it brings one document to 0 or 1; the order is a hash.  Blocks of a few hundred documents
of one source do so side by side (a hot source is many blocks); the few documents that each block
leaves fractional meet in larger blocks, until at most LANDING remain per source.  Those are landed
together by the subset whose words come nearest the target.

Defined cases: a null text has size 0; a null source is a source of its own; a null doc_id is an id like any other; rows
that repeat doc_id, source and text are one entry with their number, so they are interchangeable and no block holds
more than its share; an empty table gives no rows.  All draws are hashes of ids and texts, so reruns agree.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, texts

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 512
LANDING = 12
#: Documents that a block may leave fractional: enough for a fine choice at the landing.
LEAVE = 4


def word_counts(batches):
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("text_hash"), pa.array([len(t.split()) for t in texts(batch)], pa.int64())], names=["doc_id", "source", "text_hash", "size"])


def text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def sized(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(word_counts, "doc_id long, source string, text_hash long, size long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: source, source_size, n_docs, target.  The windows run over one row per source."""
    one = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = one.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1))
    weighed = weighed.withColumn("most", MOST * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight"))
    ordered = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, after, whole = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(0, Window.unboundedFollowing), ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (SHARE * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("level", level)
    # The first source that its share does not fill fixes the level of all sources that are not full.
    fixed = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(whole)["level"]
    return levels.select("source", "source_size", "n_docs", F.least("most", F.coalesce(F.col("weight") * fixed, F.col("most"))).alias("target"))


def uniform(*key) -> float:
    return xxhash.xxh3_64_intdigest("|".join(map(str, key))) / 2**64


def step(p: list[float], s: list[int], i: int, j: int, k: int, u: float) -> None:
    """One move of the flight for three fractional documents; at least one of them lands."""
    d = [s[j] - s[k], s[k] - s[i], s[i] - s[j]]
    if not any(d):
        d = [1, -1, 0]
    at = (i, j, k)
    up = min((1 - p[x]) / y if y > 0 else p[x] / -y for x, y in zip(at, d) if y)
    down = min(p[x] / y if y > 0 else (1 - p[x]) / -y for x, y in zip(at, d) if y)
    go = up if u * (up + down) < down else -down
    for x, y in zip(at, d):
        p[x] = min(1.0, max(0.0, p[x] + go * y))
        if p[x] < 1e-9:
            p[x] = 0.0
        elif p[x] > 1 - 1e-9:
            p[x] = 1.0


def flight(p: list[float], s: list[int], seed: str, leave: int) -> None:
    """Moves p in place until at most leave (two at least) fractional documents remain."""
    waiting = [i for i, x in enumerate(p) if 0 < x < 1]
    left, n = len(waiting), 0
    held: list[int] = []
    waiting.reverse()
    while left > max(2, leave):
        while len(held) < 3:
            held.append(waiting.pop())
        step(p, s, *held, uniform(seed, n))
        n += 1
        still = [i for i in held if 0 < p[i] < 1]
        left -= len(held) - len(still)
        held = still


def land(p: list[float], s: list[int]) -> None:
    """Rounds the few remaining probabilities so that the words, then the documents, miss by least."""
    at = [i for i, x in enumerate(p) if 0 < x < 1]
    if not at:
        return
    q, w = np.array([p[i] for i in at]), np.array([s[i] for i in at], float)
    z = np.array(list(itertools.product((0.0, 1.0), repeat=len(at))))
    best = np.lexsort((np.abs((z - q).sum(1)), np.round(np.abs((z - q) @ w), 6)))[0]
    for i, x in zip(at, z[best]):
        p[i] = float(x)


KEY = ("doc_id", "source", "text_hash")
FLOWN = "doc_id long, source string, text_hash long, size long, source_size long, target double, n long, certain long, more long, p double"


def one_block(last: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (xxhash.xxh3_64_intdigest(f"{r['doc_id']}|{r['text_hash']}"), r["size"]))
        p, s = [r["p"] for r in rows], [r["size"] for r in rows]
        seed = f"{rows[0]['source']}|{rows[0]['block']}"
        flight(p, s, seed, LANDING if last else LEAVE)
        if last:
            land(p, s)
        for r, x in zip(rows, p):
            r["p"] = x
        return pa.Table.from_pylist(rows, table.schema).select([c.split()[0] for c in FLOWN.split(", ")])

    return run


def planned(docs: DataFrame) -> DataFrame:
    """Per document and text (KEY): size, source_size, target, n (rows that repeat it), certain copies of each row, and
    more, how many of the rows are taken once more."""
    sizes = sized(docs).groupBy(*KEY, "size").agg(F.count("*").alias("n"))
    sizes = stored(sizes, "mix-sizes")
    targets = stored(source_targets(sizes), "mix-targets")
    joined = sizes.alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source")).select("d.*", "source_size", "target", "n_docs")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = joined.withColumn("ratio", ratio).withColumn("certain", F.floor("ratio"))
    # n rows of one text are taken n times the fraction once more: so many for certain, one more by its inclusion probability.
    rows = rows.withColumn("over", F.col("n") * (F.col("ratio") - F.col("certain"))).withColumn("more", F.floor("over")).withColumn("p", F.col("over") - F.col("more"))
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    wide = BLOCK
    blocks = F.ceil(F.col("n_docs") / F.lit(wide))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash"), blocks)).drop("n_docs", "ratio", "over")
    done = None
    while most > wide:
        flown = stored(rows.groupBy("source", "block").applyInArrow(one_block(False), FLOWN), "mix-flight")
        fractional = (F.col("p") > 0) & (F.col("p") < 1)
        settled = flown.filter(~fractional)
        done = settled if done is None else done.unionByName(settled)
        most = LEAVE * math.ceil(most / wide)
        blocks = max(1, math.ceil(most / wide))
        rows = flown.filter(fractional).withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(blocks)))
    flown = rows.withColumn("block", F.lit(0).cast("long")).groupBy("source").applyInArrow(one_block(True), FLOWN)
    flown = stored(flown, "mix-landed")
    flown = flown if done is None else done.unionByName(flown)
    return flown.withColumn("more", F.col("more") + F.col("p").cast("long")).drop("p")


def cube_mix(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies."""
    wide = 1 << 16  # repeats come out in runs of so many, never all in one array
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / wide)))
    rows = planned(docs).withColumn("run", runs)
    inside = F.least(F.lit(wide).cast("long"), F.col("n") - F.col("run") * wide) - 1
    rows = rows.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), inside)))
    copies = F.col("certain") + (F.col("row") + F.col("run") * wide < F.col("more")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with their columns."""
    plan = planned(docs).filter("certain + more > 0").select(*(F.col(k).alias(f"__mix_{k}") for k in (*KEY, "n", "certain", "more")))
    same = [F.col("doc_id").cast("long").eqNullSafe(F.col("__mix_doc_id")), F.col("source").cast("string").eqNullSafe(F.col("__mix_source")), F.col("__text_hash") == F.col("__mix_text_hash")]
    taken = docs.withColumn("__text_hash", text_hash()).join(plan, same[0] & same[1] & same[2])
    plain = F.col("__mix_more").isin(0) | (F.col("__mix_more") == F.col("__mix_n"))
    copies = F.col("__mix_certain") + (F.col("__mix_more") > 0).cast("long")

    def repeated(rows: DataFrame, copies) -> DataFrame:
        return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))).select(*docs.columns)

    # Rows that repeat a text, of which some are taken once more: they are numbered in parts by a salt.
    part = stored(taken.filter(~plain).withColumn("__row", F.monotonically_increasing_id()).withColumn("__salt", F.pmod(F.xxhash64("__row"), F.lit(256))), "mix-repeated")
    out = repeated(taken.filter(plain), copies)
    if part.isEmpty():
        return out
    keys = ["__mix_doc_id", "__mix_source", "__mix_text_hash"]
    counts = part.groupBy(*keys, "__salt").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(k).alias("k" + k) for k in keys), F.col("__salt").alias("k__salt"), before.alias("__before"))
    match = F.lit(True)
    for k in [*keys, "__salt"]:
        match = match & F.col(k).eqNullSafe(F.col("k" + k))
    number = F.col("__before") + F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy("__row"))
    numbered = part.join(counts, match).withColumn("__copies", F.col("__mix_certain") + (number <= F.col("__mix_more")).cast("long"))
    return out.unionByName(repeated(numbered.filter("__copies > 0"), F.col("__copies")))
