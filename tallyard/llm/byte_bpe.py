"""Byte-level BPE encoding and decoding by overlapping chunks.

Every text is cut into chunks of CHUNK code points that overlap by OVERLAP; each chunk is
pre-tokenised from its own start and its pieces encoded.  Where a chunk and its successor both have a
piece boundary inside the overlap, the pre-tokens have resynchronised: from a common boundary on, the pattern
sees the same text, so the earlier chunk's pieces are used before the first such boundary and the later chunk's
after it.  Pieces that reach the end of a cut chunk (and the one before, because the pattern looks one
character ahead) are never used.  Where no common boundary exists (a run longer than the overlap), the
stitcher pre-tokenises on from the last safe boundary by itself.  Texts of up to LOCAL chunks are cut, encoded and stitched
where they are read and never shuffle; the chunks of longer ones are dealt to tasks and stitched by document.
A piece that is no token itself is merged from its bytes, always the leftmost pair of least rank.  Decoding concatenates the bytes of
the ids.

Defined cases: a null or empty text has no ids (n_tokens 0, hashes of the empty string); repeated rows give
repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, worker_cache

CHUNK = 1 << 11
OVERLAP = 1 << 7
LOCAL = 32
CACHE = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merged(ranks: dict[bytes, int], piece: bytes) -> tuple[int, ...]:
    """The ids of one piece: its neighbours of least rank are merged, the leftmost of equal ones first, while any pair has a rank.

    Parts are named by where they start; end and before link them, and a heap holds the pairs, so a piece of n bytes takes n log n steps.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if j < 0 or j >= n or end[j] != stop:
            continue  # one of the two has been merged with another
        end[i], end[j], before[stop] = stop, -1, i
        if stop < n and (r := ranks.get(piece[i : end[stop]])) is not None:
            heapq.heappush(heap, (r, i, end[stop]))
        h = before[i]
        if h >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return tuple(ranks[piece[i : end[i]]] for i in range(n) if end[i] > 0)


class ByteBpe:
    """Encoder and decoder for a rank file and a pre-token pattern, with a bounded memory of pieces."""

    def __init__(self, path: str, pattern: str, cache: int = CACHE):
        import regex

        self.ranks = ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.decimal = {i: str(i).encode() for i in ranks.values()}
        self.known: dict[str, tuple[int, ...]] = {}
        self.cache = cache

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode_pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        known = self.known
        try:
            return list(map(known.__getitem__, pieces))
        except KeyError:
            pass
        out = []
        for p in pieces:
            ids = known.get(p)
            if ids is None:
                ids = merged(self.ranks, p.encode())
                if len(p) < 64:
                    if len(known) >= self.cache:
                        known.clear()
                    known[p] = ids
            out.append(ids)
        return out

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        parts = cut(text, chunk, overlap)
        return stitch(self, [(at, part, *chunk_tokens(self, at, part, k == len(parts))) for k, (at, part) in enumerate(parts, 1)])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, ids) -> tuple[int, str, str]:
        """n_tokens, sha256 of the ids as decimal text, sha256 of the decoded bytes."""
        return len(ids), hashlib.sha256(b",".join(map(self.decimal.__getitem__, ids))).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def coder(path: str, pattern: str) -> ByteBpe:
    cache = worker_cache("byte_bpe")
    if (path, pattern) not in cache:
        cache[path, pattern] = ByteBpe(path, pattern)
    return cache[path, pattern]


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """(offset, chunk text): chunk code points and the overlap after them."""
    return [(at, text[at : at + chunk + overlap]) for at in range(0, max(1, len(text)), chunk)]


def chunk_tokens(bpe: ByteBpe, offset: int, text: str, last: bool) -> tuple[list[int], list[tuple[int, ...]]]:
    """Absolute boundaries (one more than pieces) and ids of the pieces that the chunk's end cannot change."""
    pieces = bpe.pieces(text)
    if not last:
        pieces = pieces[:-2]
    ends = list(itertools.accumulate(map(len, pieces), initial=offset))
    return ends, bpe.encode_pieces(pieces)


def stitch(bpe: ByteBpe, chunks: list[tuple[int, str, list[int], list[tuple[int, ...]]]]) -> list[int]:
    """The ids of the whole text from its chunks: (offset, text, boundaries, ids by piece), in order."""
    out: list[tuple[int, ...]] = []
    run, text, ends, ids = chunks[0]  # the run in use: where it starts, its text, boundaries and ids
    start = 0  # the boundary of the run from which its pieces are used
    tried = run + len(text) - ends[-1]  # how much of its text has no boundary
    for k, (offset, chunk, next_ends, next_ids) in enumerate(chunks[1:], 2):
        where = {b: i for i, b in enumerate(next_ends[: bisect_right(next_ends, ends[-1])])}
        meet = next((i for i in range(bisect_left(ends, offset, start), len(ends)) if ends[i] in where), None)
        if meet is None:
            # The run's pieces hold up to its last boundary; pre-tokenise on from there, each time over twice the text at least.
            out += ids[start:]
            safe = ends[-1]
            text = text[safe - run :] + chunk[run + len(text) - offset :]
            run, start = safe, 0
            if len(text) >= 2 * tried or k == len(chunks):
                ends, ids = chunk_tokens(bpe, safe, text, k == len(chunks))
                tried = run + len(text) - ends[-1]
            else:
                ends, ids = [safe], []
        else:
            out += ids[start:meet]
            start = where[ends[meet]]
            run, text, ends, ids = offset, chunk, next_ends, next_ids
            tried = run + len(text) - ends[-1]
    out += ids[start:]
    return list(itertools.chain.from_iterable(out))


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CHUNKS = "doc_id long, doc_key long, offset long, last boolean, chunk string"
CODED = CHUNKS + ", ends binary, counts binary, ids binary"


def results(doc_ids, found) -> pa.RecordBatch:
    columns = list(zip(*found)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def bpe_documents(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, local: int = LOCAL) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def short(batches):
        bpe = coder(path, pattern)
        for batch in slices(batches):
            yield results(batch.column("doc_id").to_pylist(), [bpe.digest(bpe.encode(t or "", chunk, overlap)) for t in batch.column("text").to_pylist()])

    def cut_up(batches):
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 33
        for batch in slices(batches, 8):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                key += 1
                parts = cut(text, chunk, overlap)
                for at in range(0, len(parts), 64):
                    some = parts[at : at + 64]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array([o for o, _ in some], pa.int64()), pa.array([at + i == len(parts) - 1 for i in range(n)], pa.bool_()), pa.array([t for _, t in some], pa.string())], names=["doc_id", "doc_key", "offset", "last", "chunk"])

    def code(batches):
        bpe = coder(path, pattern)
        for batch in slices(batches, 16):
            coded = []
            for offset, last, text in zip(*(batch.column(c).to_pylist() for c in ("offset", "last", "chunk"))):
                ends, ids = chunk_tokens(bpe, offset, text, last)
                flat = list(itertools.chain.from_iterable(ids))
                coded.append((np.array(ends, np.int64).tobytes(), np.array([len(x) for x in ids], np.int32).tobytes(), np.array(flat, np.int32).tobytes()))
            columns = list(zip(*coded)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.binary()) for c in columns)], names=[*batch.schema.names, "ends", "counts", "ids"])

    def join_up(table: pa.Table) -> pa.Table:
        bpe = coder(path, pattern)
        chunks = []
        for r in sorted(table.to_pylist(), key=lambda r: r["offset"]):
            flat, ids, at = np.frombuffer(r["ids"], np.int32).tolist(), [], 0
            for n in np.frombuffer(r["counts"], np.int32).tolist():
                ids.append(tuple(flat[at : at + n]))
                at += n
            chunks.append((r["offset"], r["chunk"], np.frombuffer(r["ends"], np.int64).tolist(), ids))
        return pa.Table.from_batches([results(table["doc_id"][:1].to_pylist(), [bpe.digest(stitch(bpe, chunks))])])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.length("text") > local * chunk, F.lit(False))
    coded = rows.filter(long).mapInArrow(cut_up, CHUNKS).repartition("doc_key", "offset").mapInArrow(code, CODED)
    return rows.filter(~long).mapInArrow(short, RESULT).unionByName(coded.groupBy("doc_key").applyInArrow(join_up, RESULT))
