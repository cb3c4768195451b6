"""Token-id files of patched frame-of-reference blocks.

A segment (one row of the written table) holds the ids of consecutive whole documents as one binary image:

    header   magic 'PFR1', block length, number of ids (uint32 each)
    index    for each block the byte position of its data in the image (uint32)
    blocks   minimum (uint32), width in bits (uint8), number of exceptions (uint8),
             the values minus the minimum, low bits packed at the width (least significant first),
             then the exceptions: positions in the block (uint8 each) and high bits (uint32 each)

The width of a block is the one that PERCENTILE of its values need; larger values keep their low bits in
place and their high bits in the exception list.  Any block can be read alone through the index.

Documents are dealt by range of doc_id, sorted in each shard, encoded and written through Spark's Parquet
writer into the shared folder; the result is computed from what is read back.  The start of a document is
the ids before it in its segment, plus those before the segment in its shard, plus the totals of earlier
shards (one number a shard).

Defined cases: a null or empty text has only the end id; a null doc_id comes first; rows that repeat a doc_id
follow each other, ordered by their text, over as many shards as their number needs; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, slices, stored, texts, worker_cache

BLOCK = 128
PERCENTILE = 0.95
SEGMENT = 1 << 17
END_ID = 2
CACHE = 800_000
MAGIC = 0x31524650


def pack_segment(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """The image of an array of unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // block)
    head = np.array([MAGIC, block, n], "<u4").tobytes()
    if not n:
        return head
    grid = np.empty(blocks * block, np.uint32)
    grid[:n] = ids
    grid[n:] = ids[(blocks - 1) * block :].min()  # padding adds neither range nor exceptions
    grid = grid.reshape(blocks, block)
    low = grid.min(1)
    over = grid - low[:, None]
    rank = min(block - 1, int(np.ceil(percentile * block)) - 1)
    need = np.partition(over, rank, 1)[:, rank].astype(np.float64)
    width = np.ceil(np.log2(need + 1)).astype(np.int64)
    high = over >> np.minimum(width, 31).astype(np.uint32)[:, None]
    high[width >= 32] = 0
    spill = high != 0
    exceptions = spill.sum(1)
    packed: list = [None] * blocks
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if w:
            bits = np.unpackbits(np.ascontiguousarray(over[at].astype("<u4")).view(np.uint8).reshape(len(at), block, 4), axis=2, bitorder="little", count=int(w))
            data = np.packbits(bits.reshape(len(at), block * int(w)), axis=1, bitorder="little")
            for i, row in zip(at.tolist(), data):
                packed[i] = row.tobytes()
        else:
            for i in at.tolist():
                packed[i] = b""
    rows, columns = np.nonzero(spill)
    columns, values = columns.astype(np.uint8), high[spill].astype("<u4")
    bounds = np.concatenate([[0], np.cumsum(exceptions)]).tolist()
    parts, starts, place = [], [], 12 + 4 * blocks
    for i, (m, w, e) in enumerate(zip(low.tolist(), width.tolist(), exceptions.tolist())):
        starts.append(place)
        part = m.to_bytes(4, "little") + bytes((w, e)) + packed[i]
        if e:
            part += columns[bounds[i] : bounds[i + 1]].tobytes() + values[bounds[i] : bounds[i + 1]].tobytes()
        parts.append(part)
        place += len(part)
    return head + np.array(starts, "<u4").tobytes() + b"".join(parts)


def unpack_block(image: bytes, k: int) -> np.ndarray:
    """The values of block k alone (the last one shortened)."""
    _, block, n = np.frombuffer(image, "<u4", 3)
    at = int(np.frombuffer(image, "<u4", 1, 12 + 4 * k)[0])
    low, width, e = int.from_bytes(image[at : at + 4], "little"), image[at + 4], image[at + 5]
    size = -(-int(block) * width // 8)
    out = np.zeros(block, np.uint32)
    if width:
        bits = np.unpackbits(np.frombuffer(image, np.uint8, size, at + 6), bitorder="little", count=int(block) * width).reshape(block, width)
        out = np.packbits(np.pad(bits, ((0, 0), (0, 32 - width))), axis=1, bitorder="little").view("<u4")[:, 0].copy()
    if e:
        where = np.frombuffer(image, np.uint8, e, at + 6 + size)
        out[where] |= np.frombuffer(image, "<u4", e, at + 6 + size + e) << np.uint32(width)
    return (out + np.uint32(low))[: min(int(block), int(n) - k * int(block))]


def unpack_segment(image: bytes) -> np.ndarray:
    """All values of an image; blocks of one width are unpacked together."""
    magic, block, n = np.frombuffer(image, "<u4", 3)
    assert magic == MAGIC, "not a token segment"
    block, n = int(block), int(n)
    blocks = -(-n // block)
    if not blocks:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(image, np.uint8)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    starts = np.frombuffer(image, "<u4", blocks, 12).astype(np.int64)
    low = raw[starts[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    width, exceptions = raw[starts + 4], raw[starts + 5]
    out = np.zeros((blocks, block), np.uint32)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        size = -(-block * int(w) // 8)
        if w:
            # Each value lies in the four bytes from its first bit's byte (five for the widest).
            bit = np.arange(block) * int(w)
            first, shift = bit >> 3, (bit & 7).astype(np.uint64)
            place = starts[at, None] + 6 + first
            v = np.zeros((len(at), block), np.uint64 if w > 24 else np.uint32)
            for k in range((int(w) + 14) // 8):
                v |= padded[place + k].astype(v.dtype) << v.dtype.type(8 * k)
            out[at] = (v >> shift.astype(v.dtype)) & v.dtype.type((1 << int(w)) - 1)
        for i in at[exceptions[at] > 0].tolist():
            e, place = int(exceptions[i]), int(starts[i]) + 6 + size
            where = np.frombuffer(image, np.uint8, e, place)
            out[i, where] |= np.frombuffer(image, "<u4", e, place + e) << np.uint32(w)
    return (out + low[:, None]).reshape(-1)[:n]


#: Words of ASCII and Latin-1 letters without an apostrophe: no pre-token of theirs mixes the kinds that PIECE splits.
PLAIN = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PIECE = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+|[0-9]|[^A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def gaps_of(found: list) -> list[int]:
    """Where a list holds None."""
    out, at = [], -1
    for _ in range(found.count(None)):
        at = found.index(None, at + 1)
        out.append(at)
    return out


class WordEncoder:
    """The ids of a lower-casing tokenizer whose pre-tokens never cross white space, remembered word by word.

    A new word is put together from its runs of letters, digits and other signs where these are pre-tokens of their
    own, so a word costs the library one call however it is punctuated.  Full memories take no more entries; the
    frequent words are in them by then.  A text that holds the string of an added token of the tokenizer, in whatever case, goes to
    the library as a whole.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.added = [t.content.encode().translate(LOWER) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.cache = cache

    def library(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that are one pre-token each, many in one call; the last id of each ends a word."""
        ids = np.array(self.tokenizer.encode(" ".join(pieces), add_special_tokens=False).ids, "<u4")
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(pieces):  # a piece that normalises to several pre-tokens
            return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *last.tolist()], last.tolist())]

    def encode(self, many: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        known, pieces = self.known, self.pieces
        lower = [t.translate(LOWER) for t in many]
        whole = [i for i, t in enumerate(lower) if any(a in t for a in self.added)]
        for i in whole:
            lower[i] = b""
        split = [t.split() for t in lower]
        found = [list(map(known.get, words)) for words in split]
        gaps = [gaps_of(ids) for ids in found]
        new = {words[i] for words, gap in zip(split, gaps) for i in gap}
        parts, odd, fresh = {}, [], {}
        for w in new:
            text = w.decode()
            if PLAIN.fullmatch(text):
                parts[w] = PIECE.findall(text)
                for p in parts[w]:
                    if p not in pieces:
                        fresh[p] = None
            else:
                odd.append(w)
        order = list(fresh)
        for at in range(0, len(order), 512):
            fresh.update(zip(order[at : at + 512], self.library(order[at : at + 512])))
        if len(pieces) < self.cache:
            pieces.update(fresh)
            fresh = pieces
        coded = {w: b"".join([fresh[p] if p in fresh else pieces[p] for p in ps]) for w, ps in parts.items()}
        for at in range(0, len(odd), 4096):
            for w, x in zip(odd[at : at + 4096], self.tokenizer.encode_batch([w.decode() for w in odd[at : at + 4096]], add_special_tokens=False)):
                coded[w] = np.array(x.ids, "<u4").tobytes()
        if len(known) < self.cache:
            known.update(coded)
        for words, ids, gap in zip(split, found, gaps):
            for i in gap:
                ids[i] = coded[words[i]]
        out = list(map(b"".join, found))
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(many[i].decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


def word_encoder(path: str) -> WordEncoder:
    cache = worker_cache("word_encoder")
    if path not in cache:
        cache[path] = WordEncoder(path)
    return cache[path]


SEGMENTS = "shard int, segment int, start long, n_ids long, doc_ids array<long>, lengths array<int>, image binary"


def write_segments(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """The written table of segments, as read back from the shared folder."""

    def run(batches):
        from pyspark import TaskContext

        encoder, shard = word_encoder(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        segment, start, doc_ids, held = 0, 0, [], []

        def row():
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([start], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([[len(x) // 4 for x in held]], pa.list_(pa.int32())), pa.array([pack_segment(ids)], pa.binary())], names=["shard", "segment", "start", "n_ids", "doc_ids", "lengths", "image"])

        size = 0
        for batch in slices(batches, 128):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts(batch))):
                doc_ids.append(doc_id)
                held.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= SEGMENT:
                    yield row()
                    segment, start, doc_ids, held, size = segment + 1, start + size, [], [], 0
        if held:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    start = F.substring("text", 1, 32)  # parts rows that share an id; in the order of the texts
    return stored(rows.repartitionByRange("doc_id", start).sortWithinPartitions("doc_id", "text").mapInArrow(run, SEGMENTS), "token-segments")


def read_documents(segments: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("total")).select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))

    def run(batches):
        for batch in slices(batches, 1):
            for doc_ids, lengths, start, before, image in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "lengths", "start", "before", "image"))):
                raw = memoryview(unpack_segment(image).astype("<u4").tobytes())
                ends = np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(begins + start + before, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.join(shards, "shard").select("doc_ids", "lengths", "start", "before", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    return read_documents(write_segments(docs, tokenizer_path, end_id))
