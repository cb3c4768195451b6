"""Embedding whitening: exact integer scatter from bit planes, eigenvectors of the covariance, whitened components.

Each entry c becomes the integer x = floor(1024 * c) + 100000.  A task packs each bit of each dimension, over 64
rows, into one word; the sum over rows of x_i * x_j is then a weighted sum of popcounts of ANDed words.  The sums are
exact at every size, n * sum(x_i x_j) - S_i * S_j is formed in whole numbers, and only then follows floating point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored

SCALE, OFFSET = 1024, 100_000
#: Components returned at most.
COMPONENTS = 8
#: Scaled entries beyond this size count as this size: sums then fit decimal(38).
LARGEST = 1 << 50
#: Rows whose planes are packed at a time.
ROWS = 16384
#: The sums of D dimensions are D * (D + 1) / 2 numbers, which the driver reads.
MOST_DIMENSIONS = 4096


@dataclass
class Whitening:
    """n rows with sums S of x; eigenvectors as columns by falling eigenvalue; share of the trace of each."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray


def usable(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null nor empty and holds finite entries only."""
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return df.where(F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(True)))


def matrix(batch: pa.RecordBatch, at: int = -1) -> np.ndarray:
    """The vectors of a batch, all of one length, as doubles."""
    lists = batch.column(at if at >= 0 else batch.num_columns + at)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def whole(values: np.ndarray) -> np.ndarray:
    """floor(1024 * c), without the offset."""
    return np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64)


def planes_of(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each used (dimension, bit): rows packed 64 to a word; with the dimension and the bit of each."""
    rows, dims = shifted.shape
    padded = np.zeros((-(-rows // 64) * 64, dims), np.int64)
    padded[:rows] = shifted
    found, owner, weight = [], [], []
    for bit in range(int(shifted.max(initial=0)).bit_length()):
        used = np.flatnonzero((shifted >> bit & 1).any(axis=0))
        bits = (padded[:, used] >> bit & 1).astype(np.uint8)
        found.append(np.packbits(bits.T.copy(), axis=1).view(np.uint64))
        owner.append(used)
        weight.append(np.full(len(used), bit))
    if not found:
        return np.zeros((0, 1), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owner), np.concatenate(weight)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of x_i and of x_i * x_j over the rows, as Python integers.

    Each dimension is shifted by its least value u = x - least >= 0, so that only used bits have planes; the shift is
    undone in whole numbers.
    """
    rows, dims = x.shape
    least = x.min(axis=0)
    words, owner, weight = planes_of(x - least)
    counts = np.zeros((len(words), len(words)), np.int64)
    for k in range(len(words)):
        counts[k, k:] = counts[k:, k] = np.bitwise_count(words[k] & words[k:]).sum(axis=1, dtype=np.int64)
    u = np.zeros(dims, object)
    by_weight: dict[int, np.ndarray] = {}
    bits = [(int(b), np.flatnonzero(weight == b)) for b in np.unique(weight)]
    for a, own in bits:
        u[owner[own]] += np.diag(counts)[own].astype(object) << a
        for b, other in bits:
            cells = by_weight.setdefault(a + b, np.zeros((dims, dims), np.int64))
            cells[np.ix_(owner[own], owner[other])] += counts[np.ix_(own, other)]
    products = np.zeros((dims, dims), object)
    for power, cells in by_weight.items():
        products += cells.astype(object) << power
    low = least.astype(object)
    products += np.outer(low, u) + np.outer(u, low) + rows * np.outer(low, low)
    return u + rows * low, products


def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each cell of a task: (i, j, sum); j = -1 for the sums, i = -1 for the number of rows."""
    n, sums, products = 0, 0, 0
    for batch in batches:
        x = whole(matrix(batch))
        for at in range(0, len(x), ROWS):
            s, p = scatter(x[at : at + ROWS])
            n, sums, products = n + len(x[at : at + ROWS]), sums + s, products + p
    if n:
        dims = len(sums)
        i, j = np.triu_indices(dims)
        cells = [n, *sums, *products[i, j]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-1], np.arange(dims), i]), pa.int32()), pa.array(np.concatenate([[-1], np.full(dims, -1), j]), pa.int32()), pa.array([str(v) for v in cells])], ["i", "j", "v"]
        )
    release()


def fit_whitening(vectors: DataFrame, column: str = "embedding") -> Whitening | None:
    """Fits on all rows of `vectors`, which must be usable() and of one length; None without rows."""
    cells = vectors.select(column).mapInArrow(partial_sums, "i int, j int, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = {(r[0], r[1]): int(r[2]) for r in cells.collect()}
    if not found:
        return None
    n = found[-1, -1]
    dims = max(i for i, _ in found) + 1
    floors = [found[i, -1] for i in range(dims)]
    centred = np.empty((dims, dims), object)  # n * n * covariance; the offset of x cancels
    for i in range(dims):
        for j in range(i, dims):
            centred[i, j] = centred[j, i] = n * found[i, j] - floors[i] * floors[j]
    covariance = np.array([[v / (n * n) for v in row] for row in centred], np.float64)
    values, vectors_ = np.linalg.eigh(covariance)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    trace = float(np.trace(covariance))
    flat = values <= trace * dims * np.finfo(float).eps * 8
    return Whitening(n, [s + n * OFFSET for s in floors], np.where(flat, 0.0, values), vectors_, values / trace if trace > 0 else np.full(dims, math.nan))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit where it fits, Python integers otherwise."""
    bound = n * int(max(abs(x.max(initial=0)), abs(x.min(initial=0)))) + max(map(abs, sums), default=0)
    if bound < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def project(batches: Iterator[pa.RecordBatch], fit: Whitening, count: int) -> Iterator[pa.RecordBatch]:
    """Per row: vec_id, deviation (null beyond 64 bits) and the whitened components (null where there is no variance)."""
    flat = fit.values[:count] <= 0
    by = fit.vectors[:, :count] / np.sqrt(np.where(flat, 1.0, fit.values[:count]))
    for batch in batches:
        far = deviations(whole(matrix(batch)) + OFFSET, fit.n, fit.sums)
        if far.dtype == object or int(np.abs(far).max(initial=0)) ** 2 * far.shape[1] >= 1 << 63:
            squares = [v if v < 1 << 63 else None for v in (far.astype(object) ** 2).sum(axis=1)]
        else:
            squares = (far * far).sum(axis=1)
        out = far.astype(np.float64) / fit.n @ by
        values = pa.array(out.ravel(), mask=np.tile(flat, len(out)))
        lists = pa.ListArray.from_arrays(np.arange(0, len(out) * count + 1, count, dtype=np.int32), values)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squares, pa.int64()), lists], ["vec_id", "deviation", "w"])
    release()


def identity_error(w: DataFrame, count: int) -> float | None:
    """Largest absolute entry of covariance minus identity over the components that vary."""
    means = w.agg(*(F.avg(F.col("w")[k]).alias(f"m{k}") for k in range(count))).first()
    live = [k for k in range(count) if means[k] is not None]
    if not live:
        return None
    far = {k: F.col("w")[k] - F.lit(means[k]) for k in live}
    pairs = [(a, b) for a in live for b in live if a <= b]
    found = w.agg(*(F.avg(far[a] * far[b]).alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(v - (a == b)) for (a, b), v in zip(pairs, found))


def whiten(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable row and component.

    Nulls: rows whose vector is null or empty or holds a null or non-finite entry go; a null id stays as it is.
    Lengths: of vectors of several lengths those of the most frequent length are fitted and returned (ties: the shorter).
    Ties and repeated rows: every row counts as often as it stands; equal eigenvalues keep eigh's order.
    Very long vectors: over MOST_DIMENSIONS entries raise ValueError.  Huge entries: beyond LARGEST they count as LARGEST.
    deviation is null where it exceeds 64 bits; a component without variance has a null whitened value.
    Empty tables give no rows.  Other columns, whatever their names, are not read.
    """
    spark = df.sparkSession
    rows = usable(df.select(F.col(id_column).alias("vec_id"), F.col(column).alias("embedding")))
    lengths = sorted(rows.groupBy(F.size("embedding").alias("d")).count().collect(), key=lambda r: (-r["count"], r["d"]))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not lengths:
        return spark.createDataFrame([], schema)
    dims = lengths[0]["d"]
    if dims > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {dims} entries: the covariance of over {MOST_DIMENSIONS} does not fit the driver")
    rows = rows.where(F.size("embedding") == dims)
    fit = fit_whitening(rows)
    count = min(components, dims)
    w = stored(rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(lambda batches: project(batches, fit, count), "vec_id long, deviation long, w array<double>"), "whitened")
    error = identity_error(w, count)
    explained = F.array(*(F.lit(None if math.isnan(v) else float(v)).cast("double") for v in fit.explained[:count]))
    return w.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
