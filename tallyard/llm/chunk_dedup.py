"""Substring deduplication by content-defined chunking with a gear rolling hash.

The gear hash of a position is the sum of GEAR[byte] << age over the last 32 bytes; its low 24 bits hang on the
last 24 bytes alone.  Of every MOST neighbouring positions the one with the least such value is a cut, so cuts
depend on content alone, find their places again after an insertion and are never more than MOST bytes apart.
The start and the end of a text are cuts too.  A chunk runs from a cut to the first cut that is LEAST bytes or more away (so it has
LEAST to LEAST + MOST - 1 bytes); one chunk starts at each cut, so chunks overlap, and one more ends with the text.  Chunks
are compared by 128-bit digests: of equal chunks the first one in the smallest doc_id stays; the others are repeats, but for those
that overlap the one that stays.  Repeats that overlap or touch form a span, which is reported (and removed by ``without_spans``).

A passage of 22 + 2 * MOST + LEAST = 191 bytes or more (51 words of 3 letters) holds a whole chunk wherever it stands: its first cut
depends on its first 23 + MOST bytes alone, and which cut ends the chunk on the LEAST + MOST - 1 bytes that follow.  Every span stands
byte for byte in earlier documents or further up in its own.  Up to 23 + MOST bytes at its start and MOST at its end may stay.

Only aggregates and equi-joins by digest are used: a chunk that a third of all documents share is one partial
sum per task and one hot key of a join that Spark splits.

Defined cases: null and empty texts and those under LEAST bytes have no chunks; repeats inside one document are
spans too; rows with a null doc_id are ignored (nothing to name); rows that repeat a doc_id are documents of their own, told
apart by text_hash, in its order, and rows that repeat the text as well are one; where a text
repeats with a period under SHORT, cuts stand one period or more apart but no more than MOST; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, texts

LEAST, MOST = 89, 40
SHORT = 8
BLOCK = 1 << 20
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=2024) for b in range(256)], np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The hash at every byte, by doubling the window five times."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    return h


def least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """Where each window of so many values has its least one (the last of equal ones), without repeats."""
    n, found = len(values), []
    for at in range(0, n - width + 1, BLOCK):
        part = values[at : at + BLOCK + width - 1]
        low = part.astype(np.uint64) << np.uint64(32) | np.arange(len(part) - 1, -1, -1, dtype=np.uint64)
        k = 1
        while k < width:
            step = min(k, width - k)
            low = np.minimum(low[:-step], low[step:])
            k += step
        found.append(at + len(part) - 1 - (low & np.uint64(0xFFFFFFFF)).astype(np.int64))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def chunk_ends(text: bytes, most: int = MOST) -> list[int]:
    """Where the cuts of a text are; the last is its length."""
    n = len(text)
    if not n:
        return []
    values = gear_hashes(np.frombuffer(text, np.uint8)) & np.uint32(0xFFFFFF)
    at = least_positions(values, most)
    again = np.zeros(len(at), bool)
    for k in range(1, SHORT):
        again |= (at >= k) & (values[at - k] == values[at])
    marks = (at + 1).tolist()
    out, last = [], 0
    for m, after, same in zip(marks, [*marks[1:], n], again.tolist()):
        if not same or after - last > most:
            out.append(m)
            last = m
    if last < n:
        out.append(n)
    return out


def chunk_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of a text start and end, in order."""
    n = len(text)
    if n < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.array([0, *chunk_ends(text)], np.int64)
    end = np.searchsorted(cuts, cuts + LEAST)
    starts, ends = cuts[end < len(cuts)], cuts[end[end < len(cuts)]]
    if ends[-1] < n:
        starts, ends = np.append(starts, starts[-1]), np.append(ends, n)
    return starts, ends


def chunked(batches):
    for batch in slices(batches):
        doc_ids, hashes, starts, ends, digests = [], [], [], [], []
        for doc_id, text_hash, text in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), texts(batch)):
            a, b = (x.tolist() for x in chunk_bounds(text))
            doc_ids += [doc_id] * len(a)
            hashes += [text_hash] * len(a)
            starts += a
            ends += b
            digests += [xxhash.xxh3_128_digest(text[x:y]) for x, y in zip(a, b)]
        both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["doc_id", "text_hash", "start", "end", "d1", "d2"])


def text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk: doc_id, text_hash, start, end (bytes), d1, d2 (digest)."""
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(chunked, "doc_id long, text_hash long, start int, end int, d1 long, d2 long")


def repeated_spans(docs: DataFrame, least_bytes: int = LEAST) -> DataFrame:
    """One row per repeated span: doc_id, text_hash, start, end (bytes of the UTF-8 text), n_chunks, first_doc_ids (who keeps its chunks)."""
    rows = chunks(docs)
    # As a table of its own, the owners meet the chunks in a join of two plain shuffles, which Spark can split.
    owners = rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    owners = stored(owners, "chunk-owners")
    shared = stored(rows.join(owners, ["d1", "d2"]), "chunk-shared")
    inside = shared.filter("doc_id = first_doc_id")
    # Which of the chunks in the first doc_id comes first; most are alone there.
    first = inside.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(F.struct("text_hash", "start", "end")).alias("first")).filter("n > 1").drop("n")
    later = (F.col("text_hash") > F.col("first.text_hash")) | ((F.col("text_hash") == F.col("first.text_hash")) & (F.col("start") >= F.col("first.end")))
    again = inside.join(stored(first, "chunk-first"), ["d1", "d2"]).filter(later).drop("first")
    repeats = shared.filter("doc_id > first_doc_id").unionByName(again).select("doc_id", "text_hash", "start", "end", "first_doc_id").dropDuplicates(["doc_id", "text_hash", "start", "end"])
    w = Window.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    apart = F.when(F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    run = repeats.withColumn("apart", apart).withColumn("run", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = run.groupBy("doc_id", "text_hash", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_chunks"), F.array_sort(F.collect_set("first_doc_id")).alias("first_doc_ids"))
    return spans.filter(F.col("end") - F.col("start") >= least_bytes).drop("run")


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the spans cut out of their texts; other columns stay as they are."""
    cuts = spans.groupBy(F.col("doc_id").alias("__cut_id"), F.col("text_hash").alias("__cut_hash")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cuts"))
    joined = docs.join(cuts, (F.col("doc_id") == F.col("__cut_id")) & (text_hash() == F.col("__cut_hash")), "left").drop("__cut_id", "__cut_hash")

    def run(batches):
        for batch in slices(batches):
            out = []
            for text, cut in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("__cuts").to_pylist()):
                if cut and text:
                    kept, at = [], 0
                    for c in cut:
                        kept.append(text[at : c["start"]])
                        at = c["end"]
                    text = b"".join([*kept, text[at:]])
                out.append(text.decode("utf-8", "ignore") if text is not None else None)
            where = batch.schema.names.index("text")
            yield batch.set_column(where, "text", pa.array(out, pa.string())).drop_columns(["__cuts"])

    return joined.mapInArrow(run, docs.schema)
