"""Hard-negative mining with Kronecker-packed inner products.

Several candidates' components, biased to be non-negative, stand in separated fields of one wide integer.  One
multiplication by an anchor's component multiplies all of them; the sum over dimensions holds every candidate's
inner product in its own field, wide enough that no carry crosses.  Fields are taken apart by shift and mask, the
bias is subtracted, and scores are exact.

Anchors are a stated share of the rows and go against all rows in blocks: a block of at most about BLOCK anchors is
one row, broadcast to the packed chunks; each task keeps the best five of an anchor over its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bit_whitening import usable
from .common import release, stored

SCALE = 256
#: Anchors of one block; blocks are dealt by a hash of the id, so that sizes differ by a few percent.  A block of
#: 512-dimensional vectors is 8 MB.
BLOCK = 2048
#: Rows of one packed chunk, and anchors multiplied at a time.
CHUNK, STEP = 4096, 128
#: Best rows kept of each list.
FIRST = 5
#: Components beyond this size count as this size, scores beyond MOST_SCORE as MOST_SCORE: 100 * score then fits a long.
LARGEST, MOST_SCORE = 1 << 52, 9 * 10**16
NONE = np.iinfo(np.int64).min


def field_bits(dims: int, largest: int) -> int:
    """Bits of a field that holds any sum of dims products of two components biased by `largest`."""
    return max(1, (dims * (2 * largest) ** 2).bit_length())


def layout(dims: int, largest: int) -> tuple[type, int, int]:
    """Number type, bits of a field, fields of a word: doubles while words are exact in them, then longs, then Python integers."""
    bits = field_bits(dims, largest)
    if 53 // bits >= 2:
        return np.float64, bits, 53 // bits
    if 63 // bits >= 1:
        return np.int64, bits, 63 // bits
    return object, bits, 2


def pack(x: np.ndarray, kind: type, bits: int, fields: int, bias: int) -> np.ndarray:
    """Rows in groups of `fields`, biased and put into one word for each dimension; the last group is filled with zeros."""
    rows, dims = x.shape
    filled = np.zeros((-(-rows // fields) * fields, dims), object if kind is object else np.int64)
    filled[:rows] = x.astype(filled.dtype) + bias
    groups = filled.reshape(-1, fields, dims)
    words = sum(groups[:, k] * (1 << bits * k) for k in range(fields))
    return words.astype(kind)


def scores(anchors: np.ndarray, words: np.ndarray, totals: np.ndarray, bits: int, fields: int, bias: int) -> np.ndarray:
    """Exact inner products of the anchors with all rows packed in the words; totals: the sum of each row's components."""
    sums = (anchors.astype(words.dtype) + bias) @ words.T
    if words.dtype == object:
        anchors, totals = anchors.astype(object), totals.astype(object)
    else:
        sums = sums.astype(np.int64)
    mask = (1 << bits) - 1
    parts = np.stack([sums >> bits * k & mask for k in range(fields)], axis=2).reshape(len(anchors), -1)[:, : len(totals)]
    out = parts - bias * anchors.sum(axis=1)[:, None] - bias * totals[None, :] - anchors.shape[1] * bias * bias
    return np.clip(out, -MOST_SCORE, MOST_SCORE).astype(np.int64) if bits > 56 else out


def best(score: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of scores, the FIRST allowed columns by score, then by place (columns stand in order of id); NONE where there are fewer."""
    n = score.shape[1]
    masked = np.where(allowed, score, NONE)
    k = min(FIRST, n)
    if n > k:
        edge = np.partition(masked, n - k, axis=1)[:, n - k]
        above, ties = masked > edge[:, None], masked == edge[:, None]
        room = k - above.sum(axis=1)
        chosen = above | ties & (np.cumsum(ties, axis=1) <= room[:, None])
        columns = np.nonzero(chosen)[1].reshape(-1, k)
    else:
        columns = np.tile(np.arange(n), (len(score), 1))
    found = np.take_along_axis(masked, columns, axis=1)
    order = np.lexsort((columns, -np.maximum(found, NONE + 1)), axis=1)
    found, columns = np.take_along_axis(found, order, axis=1), np.take_along_axis(columns, order, axis=1)
    return found, ids[columns]


def merge(kept: tuple[np.ndarray, np.ndarray] | None, new: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if kept is not None:
        new = np.concatenate([kept[0], new[0]], axis=1), np.concatenate([kept[1], new[1]], axis=1)
    order = np.lexsort((new[1], -np.maximum(new[0], NONE + 1)), axis=1)[:, :FIRST]
    return np.take_along_axis(new[0], order, axis=1), np.take_along_axis(new[1], order, axis=1)


def as_bytes(a: np.ndarray) -> bytes:
    return "\n".join(map(str, a.ravel())).encode() if a.dtype == object else a.tobytes()


def as_array(b: bytes, kind: type) -> np.ndarray:
    return np.array([int(v) for v in b.split()], object) if kind is object else np.frombuffer(b, kind)


CHUNKS = "dims int, ids binary, labels binary, totals binary, words binary, slots int"


def chunks(batches: Iterator[pa.RecordBatch], shapes: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, x) rows as packed chunks, one length of vectors each, in order of id; shapes: the largest component by length."""

    def emit(dims: int, rows: list) -> pa.RecordBatch:
        ids, labels, x = (np.concatenate(v) for v in zip(*rows))
        order = np.argsort(ids, kind="stable")
        ids, labels, x = ids[order], labels[order], x[order]
        kind, bits, fields = layout(dims, shapes[dims])
        words = pack(x, kind, bits, fields, shapes[dims])
        cells = [dims, ids.tobytes(), labels.tobytes(), as_bytes(x.astype(object).sum(axis=1) if kind is object else x.sum(axis=1)), as_bytes(words), len(ids)]
        return pa.RecordBatch.from_pylist([dict(zip(("dims", "ids", "labels", "totals", "words", "slots"), cells))], pa.schema([("dims", pa.int32())] + [(n, pa.binary()) for n in ("ids", "labels", "totals", "words")] + [("slots", pa.int32())]))

    held: dict[int, list] = {}
    for batch in batches:
        ids, labels, lists = (batch.column(k) for k in range(3))
        lengths = np.diff(lists.offsets.to_numpy())
        ids, labels = ids.to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False)
        for dims in np.unique(lengths):
            at = np.flatnonzero(lengths == dims)
            x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
            for k in range(0, len(at), CHUNK):
                own = held.setdefault(int(dims), [])
                own.append((ids[at[k : k + CHUNK]], labels[at[k : k + CHUNK]], x[k : k + CHUNK]))
                if sum(len(r[0]) for r in own) >= CHUNK:
                    yield emit(int(dims), held.pop(int(dims)))
    for dims, rows in held.items():
        yield emit(dims, rows)
    release()


def unpacked(batch: pa.RecordBatch, shapes: dict[int, int]) -> Iterator[tuple]:
    for row in batch.to_pylist():
        kind, bits, fields = layout(row["dims"], shapes[row["dims"]])
        words = as_array(row["words"], kind).reshape(-1, row["dims"])
        yield row, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), as_array(row["totals"], object if kind is object else np.int64), words, bits, fields


def positives_of(batches: Iterator[pa.RecordBatch], shapes: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Each task's best rows of the anchor's label: (anchor, score, other)."""
    kept: dict[int, tuple] = {}
    for batch in batches:
        for row, ids, labels, totals, words, bits, fields in unpacked(batch, shapes):
            keys, own, own_labels = (np.array([a[n] for a in row["anchors"]], np.int64) for n in ("anchor", "vec_id", "label"))
            x = np.array([a["x"] for a in row["anchors"]], np.int64).reshape(len(own), -1)
            for label in np.unique(own_labels):
                at, groups = np.flatnonzero(own_labels == label), np.unique(np.flatnonzero(labels == label) // fields)
                if not len(groups):
                    continue
                slots = (groups[:, None] * fields + np.arange(fields)).ravel()
                slots = slots[slots < len(ids)]
                for k in range(0, len(at), STEP):
                    who = at[k : k + STEP]
                    score = scores(x[who], words[groups], totals[slots], bits, fields, shapes[row["dims"]])
                    found, other = best(score, (labels[slots] == label) & (ids[slots] != own[who, None]), ids[slots])
                    for i, a in enumerate(who):
                        kept[int(keys[a])] = merge(kept.get(int(keys[a])), (found[i : i + 1], other[i : i + 1]))
    yield from listed(kept)


def negatives_of(batches: Iterator[pa.RecordBatch], shapes: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Each task's best rows of other labels within the window of each positive: (pair, score, other)."""
    kept: dict[int, tuple] = {}
    for batch in batches:
        for row, ids, labels, totals, words, bits, fields in unpacked(batch, shapes):
            for k in range(0, len(row["anchors"]), STEP):
                part = row["anchors"][k : k + STEP]
                own, own_labels = (np.array([a[n] for a in part], np.int64) for n in ("vec_id", "label"))
                x = np.array([a["x"] for a in part], np.int64).reshape(len(own), -1)
                score = scores(x, words, totals, bits, fields, shapes[row["dims"]])
                other_label = (labels != own_labels[:, None]) & (ids != own[:, None])
                hundred = 100 * score
                for nth in range(FIRST):
                    who = np.array([i for i, a in enumerate(part) if len(a["positives"]) > nth], np.int64)
                    if not len(who):
                        break
                    limit = np.array([part[i]["positives"][nth]["score"] for i in who], np.int64)[:, None]
                    allowed = other_label[who] & (80 * limit <= hundred[who]) & (hundred[who] <= 100 * limit)
                    some = allowed.any(axis=1)
                    if not some.any():
                        continue
                    found, other = best(score[who[some]], allowed[some], ids)
                    for i, a in enumerate(who[some]):
                        key = part[a]["positives"][nth]["pair"]
                        kept[key] = merge(kept.get(key), (found[i : i + 1], other[i : i + 1]))
    yield from listed(kept)


def listed(kept: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    if kept:
        keys = np.array(list(kept))
        found, other = (np.concatenate([np.pad(v[k], ((0, 0), (0, FIRST - v[k].shape[1])), constant_values=NONE) for v in kept.values()]) for k in (0, 1))
        real = found != NONE
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, FIRST)[real.ravel()]), pa.array(found[real]), pa.array(other[real])], ["key", "score", "other"])
    release()


def against_all(packed: DataFrame, anchors: DataFrame, blocks: int, task) -> DataFrame:
    """The packed chunks against each block of anchors: rows (key, score, other), the best FIRST of each task."""
    found = None
    fields = [c for c in anchors.columns if c not in ("block", "dims")]
    for b in range(blocks):
        block = anchors.where(F.col("block") == b).groupBy("dims").agg(F.collect_list(F.struct(*fields)).alias("anchors"))
        one = packed.join(F.broadcast(block), "dims").mapInArrow(task, "key long, score long, other long")
        found = one if found is None else found.unionAll(one)
    return found


def first_of(df: DataFrame, columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*columns).orderBy(F.desc("score"), "other")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= FIRST)


def hard_negatives(df: DataFrame, is_anchor=None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    df: vec_id, embedding, label; is_anchor: a condition on them, by default vec_id % 100 = 0.
    Nulls: rows with a null id, label or vector or with a null, infinite or NaN component take no part.
    Ties: equal scores go by the smaller vec_id.  Repeated rows: each takes its own place in a list, an anchor that
    repeats counts once, and rows that share the anchor's id are never its positives or negatives.
    Vectors of different lengths never meet; empty vectors take no part.  Huge components count as LARGEST, scores
    beyond MOST_SCORE as MOST_SCORE.  Long vectors: fields grow with the length, past 63 bits as Python integers.
    Empty tables and anchors without positives or negatives give no rows.  Other columns, whatever their names, are not read.
    """
    spark = df.sparkSession
    x = F.transform("embedding", lambda v: F.greatest(F.least(F.floor(v.cast("double") * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("long"))
    rows = usable(df.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL"))
    rows = rows.select("vec_id", "label", x.alias("x"))
    largest = F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))
    shapes = {r["d"]: max(1, r["m"]) for r in rows.groupBy(F.size("x").alias("d")).agg(largest.alias("m")).collect()}
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not shapes:
        return spark.createDataFrame([], schema)
    packed = stored(rows.mapInArrow(lambda batches: chunks(batches, shapes), CHUNKS), "negative-chunks")
    anchors = rows.where(F.col("vec_id") % 100 == 0 if is_anchor is None else is_anchor).dropDuplicates()
    anchors = stored(anchors.select("*", F.size("x").alias("dims"), F.monotonically_increasing_id().alias("anchor")), "negative-anchors")
    blocks = max(1, -(-anchors.count() // BLOCK))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)))
    positives = first_of(against_all(packed, anchors, blocks, lambda batches: positives_of(batches, shapes)), ["key"])
    positives = stored(positives.select("key", "score", "other", (F.col("key") * FIRST + F.col("rank") - 1).alias("pair")), "negative-positives")
    lists = positives.groupBy(F.col("key").alias("anchor")).agg(F.array_sort(F.collect_list(F.struct("pair", "score"))).alias("positives"))
    joined = stored(anchors.join(lists, "anchor"), "negative-anchors")
    negatives = first_of(against_all(packed, joined, blocks, lambda batches: negatives_of(batches, shapes)), ["key"])
    names = joined.select(F.col("anchor").alias("key_"), F.col("vec_id").alias("anchor_id"))
    pairs = positives.select(F.col("key").alias("key_"), "pair", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")).join(names, "key_")
    return negatives.join(pairs, F.col("key") == F.col("pair")).select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
