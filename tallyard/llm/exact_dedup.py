"""Exact deduplication by Grace hashing.

Texts are equal when they agree after every character of [\\x20\\x09-\\x0D] is deleted.  Each input
partition first merges its own copies in an open-addressing table (so a text that makes up a third of
the corpus shuffles once per partition and not once per row), then the distinct contents are dealt by
hash.  A bucket that outgrows the memory allowance is split into spill files by another hash, again and
again, until the table holds it; the table compares complete contents.  The verdicts return to the rows
by a join on the SHA-256 of the content, which Spark's skew handling splits for hot groups.

Defined cases: a null text counts as empty, and all empty texts are equal.  Of equal texts the one with
the most code points stays, then the smallest doc_id (a null id comes last).  ``exact_dedup`` marks
each row by its doc_id, so rows that repeat the id that stays are all marked as kept; ``deduplicate`` keeps one of them, with its other columns.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import pickle
import tempfile

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, slices, texts

FANOUT = 16
MAX_DEPTH = 12


class ContentTable:
    """Open addressing with linear probing; equal entries merge after a comparison of the whole content."""

    def __init__(self) -> None:
        self.mask = 1023
        self.slots = [-1] * (self.mask + 1)
        self.entries: list[list] = []  # hash, content, rows, code points and id of the best row
        self.bytes = 0

    def add(self, content: bytes, rows: int, length: int, doc_id: int | None) -> None:
        h = xxhash.xxh3_64_intdigest(content)
        at = h & self.mask
        while (e := self.slots[at]) >= 0:
            entry = self.entries[e]
            if entry[0] == h and entry[1] == content:
                entry[2] += rows
                if better(length, doc_id, entry[3], entry[4]):
                    entry[3], entry[4] = length, doc_id
                return
            at = (at + 1) & self.mask
        self.slots[at] = len(self.entries)
        self.entries.append([h, content, rows, length, doc_id])
        self.bytes += len(content) + 200
        if 2 * len(self.entries) > self.mask:
            self.grow()

    def grow(self) -> None:
        self.mask = 4 * self.mask + 3
        self.slots = [-1] * (self.mask + 1)
        for e, entry in enumerate(self.entries):
            at = entry[0] & self.mask
            while self.slots[at] >= 0:
                at = (at + 1) & self.mask
            self.slots[at] = e

    def records(self):
        return ((e[1], e[2], e[3], e[4]) for e in self.entries)


def better(length: int, doc_id: int | None, than_length: int, than_id: int | None) -> bool:
    if length != than_length:
        return length > than_length
    return doc_id is not None and (than_id is None or doc_id < than_id)


def unpickled(path: str):
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def grace(records, memory: int, folder: str, depth: int = 0):
    """Merged (content, rows, code points, id) of a stream of such records, in bounded memory."""
    table, records = ContentTable(), iter(records)
    for record in records:
        table.add(*record)
        if table.bytes > memory and len(table.entries) > 1 and depth < MAX_DEPTH:
            names = [os.path.join(folder, f"{depth}-{i}-{os.urandom(6).hex()}") for i in range(FANOUT)]
            files = [open(n, "wb") for n in names]
            try:
                for r in itertools.chain(table.records(), records):
                    pickle.dump(r, files[xxhash.xxh3_64_intdigest(r[0], seed=depth + 1) % FANOUT], 5)
            finally:
                for f in files:
                    f.close()
            del table
            for n in names:
                yield from grace(unpickled(n), memory, folder, depth + 1)
                os.unlink(n)
            return
    yield from table.records()


def merged_in_partition(memory: int):
    def run(batches):
        table = ContentTable()

        def flush():
            entries = table.entries
            for at in range(0, len(entries), 512):
                part = entries[at : at + 512]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([xxhash.xxh3_64_intdigest(e[1], seed=99) >> 1 for e in part], pa.int64()), pa.array([e[1] for e in part], pa.binary()), *(pa.array([e[i] for e in part], pa.int64()) for i in (2, 3, 4))],
                    names=["bucket", "content", "n_rows", "length", "doc_id"],
                )

        for batch in slices(batches):
            for content, length, doc_id in zip(texts(batch), batch.column("length").to_pylist(), batch.column("doc_id").to_pylist()):
                table.add(content.translate(None, WHITE), 1, length or 0, doc_id)
            if table.bytes > memory:
                yield from flush()
                table = ContentTable()
        yield from flush()

    return run


def merged_in_bucket(memory: int):
    def run(batches):
        def records():
            for batch in slices(batches):
                yield from zip(*(batch.column(c).to_pylist() for c in ("content", "n_rows", "length", "doc_id")))

        seen: dict[str, list] = {"text_sha256": [], "keep_id": [], "keep_length": [], "group_size": []}

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(seen["text_sha256"], pa.string()), pa.array(seen["keep_id"], pa.int64()), pa.array(seen["keep_length"], pa.int64()), pa.array(seen["group_size"], pa.int64())], names=list(seen))
            for v in seen.values():
                v.clear()
            return out

        with tempfile.TemporaryDirectory() as folder:
            for content, rows, length, doc_id in grace(records(), memory, folder):
                seen["text_sha256"].append(hashlib.sha256(content).hexdigest())
                seen["keep_id"].append(doc_id)
                seen["keep_length"].append(length)
                seen["group_size"].append(rows)
                if len(seen["keep_id"]) >= 8192:
                    yield batch()
        yield batch()

    return run


def exact_groups(docs: DataFrame, memory: int = 48 << 20) -> DataFrame:
    """One row per distinct content: text_sha256, keep_id, keep_length (code points), group_size.  memory: bytes of content a task holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("length"), F.col("text").cast("string").alias("text"))
    local = rows.mapInArrow(merged_in_partition(memory), "bucket long, content binary, n_rows long, length long, doc_id long")
    return local.repartition("bucket").mapInArrow(merged_in_bucket(memory), "text_sha256 string, keep_id long, keep_length long, group_size long")


def content_sha256(text):
    squeezed = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")
    return F.sha2(squeezed.cast("binary"), 256)


def exact_dedup(docs: DataFrame, memory: int = 48 << 20) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select("doc_id", content_sha256(F.col("text")).alias("text_sha256"))
    return rows.join(exact_groups(docs, memory), "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, memory: int = 48 << 20) -> DataFrame:
    """One row of docs for each content, with its columns: the row that stays; of rows that repeat its id and content, one."""
    key = lambda sha, doc_id, length: F.concat_ws(" ", sha, F.coalesce(doc_id.cast("string"), F.lit("-")), length)
    keep = exact_groups(docs, memory).select(key(F.col("text_sha256"), F.col("keep_id"), F.col("keep_length")).alias("__key"))
    marked = docs.withColumn("__key", key(content_sha256(F.col("text")), F.col("doc_id").cast("long"), F.coalesce(F.length(F.col("text").cast("string")), F.lit(0))))
    # The join deals the rows by __key, so no further shuffle drops the repeats.
    return marked.join(keep, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
