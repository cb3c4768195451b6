"""Boosted regression trees from histograms, several settings side by side, with early stopping.

The input is read once and stored.  Columns become bins (quantiles of numbers, one bin for each frequent category), and training rows are stored by the
block, as arrays with the scores so far; the other rows meet the trees once, at the end.  Growing all trees by one level is one job: each task finds the node of its rows, adds gradients
and counts up by (setting, node, column, bin), and Spark sums these cells, whose number depends on the trees and not on
the rows.  Splits are chosen from the cells: ranges of bins for numbers, and for categories sets of bins in order of their
mean gradient.  Leaf weights carry an L2 penalty.  After each tree the loss on a validation slice decides whether a setting goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.functions.scalars import hash_uniform
from tallyard.sources.readers import stored

from .metrics import auc, regression_metrics

#: Bins of a column; bin 0 holds nulls, categories past the most frequent share the last one.
BINS = 256
#: Finished trees of a setting that tasks apply on the fly, before scores are stored anew.
PENDING = 12
#: Rows of a block, whose arrays fit a cache.
BLOCK = 8192
BLOCKS = "held boolean, b binary, y binary, part binary, f binary"


@dataclass(frozen=True)
class Boosting:
    name: str
    rate: float
    leaves: int
    least: int
    l2: float


@dataclass
class Tree:
    """Node k goes to left[k] or right[k] by whether its column's bin is in goes[k]; a leaf has column -1 and a value."""

    column: list[int] = field(default_factory=lambda: [-1])
    goes: list[np.ndarray | None] = field(default_factory=lambda: [None])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins ends in: all rows go down a level at once, by look-ups."""
        at, live = np.zeros(len(bins), np.int32), np.arange(len(bins) if self.column[0] >= 0 else 0)
        column, left, right = np.array(self.column), np.array(self.left, np.int32), np.array(self.right, np.int32)
        goes = np.stack([np.zeros(BINS, bool) if g is None else g for g in self.goes]).ravel()
        flat, width = bins.ravel(), bins.shape[1]
        while len(live):
            node = at[live]
            inside = goes[node * BINS + flat[live * width + column[node]]]
            node = np.where(inside, left[node], right[node])
            at[live] = node
            live = live[column[node] >= 0]
        return at

    def split(self, k: int, column: int, goes: np.ndarray, values: tuple[float, float]) -> tuple[int, int]:
        self.column[k], self.goes[k], self.left[k], self.right[k] = column, goes, len(self.column), len(self.column) + 1
        for v in values:
            for name, x in (("column", -1), ("goes", None), ("left", -1), ("right", -1), ("value", v)):
                getattr(self, name).append(x)
        return self.left[k], self.right[k]


def best_split(n: np.ndarray, g: np.ndarray, categorical: bool, least: int, l2: float) -> tuple[float, np.ndarray] | None:
    """(gain, bins that go left) of one column of a node, or None: n and g are counts and gradient sums by bin."""
    used = np.flatnonzero(n)
    if len(used) < 2:
        return None
    if categorical:
        used = used[np.argsort(g[used] / (n[used] + l2), kind="stable")]
    left_n, left_g = np.cumsum(n[used])[:-1], np.cumsum(g[used])[:-1]
    all_n, all_g = n.sum(), g.sum()
    gain = left_g**2 / (left_n + l2) + (all_g - left_g) ** 2 / (all_n - left_n + l2) - all_g**2 / (all_n + l2)
    gain[(left_n < least) | (all_n - left_n < least)] = -np.inf
    k = int(np.argmax(gain))
    if not gain[k] > 1e-9 * max(1.0, all_g**2 / max(1, all_n)):
        return None
    goes = np.zeros(BINS, bool)
    if categorical:
        goes[used[: k + 1]] = True
    else:
        goes[: used[k] + 1] = True
    return float(gain[k]), goes


@dataclass
class Grower:
    """The state of one setting: finished trees, the tree in growth, and how the validation loss went."""

    setting: Boosting
    rounds: int
    patience: int
    trees: list[Tree] = field(default_factory=list)
    tree: Tree = field(default_factory=Tree)
    frontier: list[int] = field(default_factory=lambda: [0])
    stored: int = 0
    best: float = np.inf
    best_at: int = 0
    done: bool = False

    def judge(self, loss: float) -> None:
        """The loss of the finished trees; past `patience` trees without gain the trees after the best go."""
        if loss < self.best * (1 - 1e-7):
            self.best, self.best_at = loss, len(self.trees)
        if len(self.trees) - self.best_at >= self.patience or len(self.trees) >= self.rounds:
            self.stop()

    def stop(self) -> None:
        self.trees, self.done, self.frontier = self.trees[: self.best_at], True, []

    def grow(self, n: np.ndarray, g: np.ndarray, categorical: list[bool]) -> None:
        """n, g: (frontier node, column, bin).  Splits by falling gain while leaves are left; then the next level or the next tree."""
        s, found = self.setting, []
        for at, k in enumerate(self.frontier):
            options = [(*b, c) for c in range(n.shape[1]) if (b := best_split(n[at, c], g[at, c], categorical[c], s.least, s.l2))]
            if options:
                gain, goes, c = max(options, key=lambda o: (o[0], -o[2]))
                found.append((gain, at, k, c, goes))
        leaves, following = sum(c < 0 for c in self.tree.column), []
        for _, at, k, c, goes in sorted(found, key=lambda f: (-f[0], f[1])):
            if leaves >= s.leaves:
                break
            values = tuple(-s.rate * g[at, c][side].sum() / (n[at, c][side].sum() + s.l2) for side in (goes, ~goes))
            following += self.tree.split(k, c, goes, values)
            leaves += 1
        if following and leaves < s.leaves:
            self.frontier = following
        elif len(self.tree.column) == 1:  # nothing left to split: further trees would add nothing
            self.stop()
        else:
            self.trees.append(self.tree)
            self.tree, self.frontier = Tree(), [0]


def edges(rows: DataFrame, categories: list[str], numbers: list[str]) -> list[list]:
    """Of each column its frequent categories, or its cut points."""
    found = [[r[0] for r in rows.groupBy(c).count().filter(F.col(c).isNotNull()).orderBy(F.desc("count"), c).limit(BINS - 2).collect()] for c in categories]
    cuts = rows.agg(*[F.percentile_approx(c, [k / (BINS - 2) for k in range(1, BINS - 2)], F.lit(100_000)).alias(f"c{k}") for k, c in enumerate(numbers)]).first() if numbers else ()
    return found + [sorted(set(e or ())) for e in cuts]


def binned(column: pa.Array, known: list, categorical: bool) -> np.ndarray:
    """Bins of a column: 0 null, then the categories by frequency or the ranges between cut points."""
    if categorical:
        place = pc.index_in(column, value_set=pa.array(known, column.type)).fill_null(BINS - 2).to_numpy(zero_copy_only=False)
    else:
        place = np.searchsorted(np.array(known, float), column.fill_null(0.0).to_numpy(zero_copy_only=False))
    return np.where(column.is_null().to_numpy(zero_copy_only=False), 0, place + 1).astype(np.int16)


def block_task(batches: Iterator[pa.RecordBatch], names: list[str], known: list[list], categories: int, start: float | None, settings: int) -> Iterator[pa.RecordBatch]:
    """Rows by the block, as arrays: held (outside training), bins, y, part, and the scores so far of a block of training rows."""
    for batch in batches:
        bins = np.stack([binned(batch.column(c), k, i < categories) for i, (c, k) in enumerate(zip(names, known))], 1) if names else np.zeros((batch.num_rows, 0), np.int16)
        y, part = batch.column("_y").to_numpy(zero_copy_only=False), batch.column("_part").to_numpy(zero_copy_only=False).astype(np.int8)
        for held in (False, True):
            own = np.flatnonzero((part == 2) == held)
            for at in range(0, len(own), BLOCK):
                rows = own[at : at + BLOCK]
                f = b"" if held else np.full((len(rows), settings), start, float).tobytes()
                yield block(held, bins[rows].tobytes(), y[rows].tobytes(), part[rows].tobytes(), f)


def block(held: bool, *arrays: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([held]), *[pa.array([a], pa.binary()) for a in arrays]], ["held", "b", "y", "part", "f"])


def blocks(batches: Iterator[pa.RecordBatch], columns: int, settings: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bins, scores, y, part) of each block."""
    for batch in batches:
        for b, y, part, f in zip(*[batch.column(c) for c in ("b", "y", "part", "f")]):
            y = np.frombuffer(y.as_buffer(), float)
            yield np.frombuffer(b.as_buffer(), np.int16).reshape(len(y), columns), np.frombuffer(f.as_buffer(), float).reshape(-1, settings).copy(), y, np.frombuffer(part.as_buffer(), np.int8)


def pending(growers: list[Grower]) -> list[list[Tree]]:
    """Trees that the stored scores lack; a setting that is done needs none, as its scores are worked out at the end."""
    return [[] if g.done else g.trees[g.stored :] for g in growers]


def applied(bins: np.ndarray, scores: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
    for s, own in enumerate(trees):
        for t in own:
            scores[:, s] += np.array(t.value)[t.nodes(bins)]
    return scores


def histogram_task(batches: Iterator[pa.RecordBatch], columns: int, trees: list[list[Tree]], growing: list[tuple[Tree, list[int]]]) -> Iterator[pa.RecordBatch]:
    """Cells (setting, node, column, bin, n, g) of the frontier nodes; node -1 holds the validation rows and their squared errors."""
    shapes = [(len(f), columns, BINS) for _, f in growing]
    n, g = [np.zeros(int(np.prod(s)), np.int64) for s in shapes], [np.zeros(int(np.prod(s))) for s in shapes]
    loss, count = np.zeros(len(trees)), 0
    for bins, scores, y, part in blocks(batches, columns, len(trees)):
        scores = applied(bins, scores, trees)
        valid, fit = part == 1, part == 0
        loss += ((scores[valid] - y[valid, None]) ** 2).sum(axis=0)
        count += int(valid.sum())
        bins, y, scores = bins[fit], y[fit], scores[fit]
        for s, (tree, frontier) in enumerate(growing):
            if not frontier:
                continue
            place = np.full(len(tree.column), -1)
            place[frontier] = np.arange(len(frontier))
            at = place[tree.nodes(bins)]
            own = at >= 0
            index = ((at[own, None] * columns + np.arange(columns)) * BINS + bins[own]).ravel()
            n[s] += np.bincount(index, minlength=len(n[s]))
            g[s] += np.bincount(index, np.repeat((scores[own, s] - y[own]), columns), len(g[s]))
    for s in range(len(trees)):
        used = np.flatnonzero(n[s])
        node, rest = np.divmod(used, columns * BINS)
        cells = [np.append(node, -1), np.append(rest // BINS, 0), np.append(rest % BINS, 0), np.append(n[s][used], count), np.append(g[s][used], loss[s])]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used) + 1, s), pa.int32()), *[pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64()))]], ["s", "node", "c", "bin", "n", "g"])


def add_task(batches: Iterator[pa.RecordBatch], columns: int, trees: list[list[Tree]]) -> Iterator[pa.RecordBatch]:
    """The blocks of training rows with the trees added to their scores."""
    for bins, scores, y, part in blocks(batches, columns, len(trees)):
        yield block(False, bins.tobytes(), y.tobytes(), part.tobytes(), applied(bins, scores, trees).tobytes())


def score_task(batches: Iterator[pa.RecordBatch], columns: int, start: float | None, trees: list[list[Tree]]) -> Iterator[pa.RecordBatch]:
    """Rows again: y, part and the scores by all trees."""
    for bins, _, y, part in blocks(batches, columns, len(trees)):
        scores = applied(bins, np.full((len(y), len(trees)), np.nan if start is None else start), trees)
        f = pa.ListArray.from_arrays(np.arange(0, scores.size + 1, len(trees), dtype=np.int32), pa.array(scores.ravel(), mask=np.full(scores.size, start is None)))
        yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(part, pa.int32()), f], ["y", "part", "f"])


def grown(df: DataFrame, train, key: str, categories: list[str], numbers: list[str], y: str, settings: list[Boosting], rounds: int, patience: int, validation: float, seed) -> tuple[DataFrame, float | None, list[Grower]]:
    """(blocks, mean of the fitted rows, growers with their trees)."""
    part = F.when(~F.coalesce(train, F.lit(False)), 2).when(hash_uniform(seed, key) < validation, 1).otherwise(0)
    names = [f"_{k}" for k in range(len(categories) + len(numbers))]
    columns, categorical = len(names), [True] * len(categories) + [False] * len(numbers)
    chosen = [*map(F.col, categories), *[F.col(c).cast("double") for c in numbers]]
    rows = stored(df.filter(F.col(y).isNotNull()).select(*[c.alias(n) for c, n in zip(chosen, names)], F.col(y).cast("double").alias("_y"), part.cast("int").alias("_part")), "boost-rows")
    fitted = rows.filter("_part = 0")
    start = fitted.agg(F.avg("_y")).first()[0]
    known = edges(fitted, names[: len(categories)], names[len(categories) :])
    whole = stored(rows.mapInArrow(lambda batches: block_task(batches, names, known, len(categories), start, len(settings)), BLOCKS), "boost-blocks")
    growers = [Grower(s, rounds, patience) for s in settings]
    if start is None:
        return whole, start, growers
    now = whole.filter("not held")
    while not all(g.done for g in growers):
        trees, growing = pending(growers), [(g.tree, g.frontier) for g in growers]
        cells = now.mapInArrow(lambda batches: histogram_task(batches, columns, trees, growing), "s int, node int, c int, bin int, n long, g double")
        found = cells.groupBy("s", "node", "c", "bin").agg(F.sum("n").alias("n"), F.sum("g").alias("g")).toArrow()
        s, node, c, b, n, total = (found.column(k).to_numpy() for k in range(6))
        for k, grower in enumerate(growers):
            if grower.done:
                continue
            held = (s == k) & (node < 0)
            if grower.frontier == [0] and n[held].sum():
                grower.judge(float(total[held].sum() / n[held].sum()))
                if grower.done:
                    continue
            own = (s == k) & (node >= 0)
            shape = (len(grower.frontier), columns, BINS)
            counts, sums = np.zeros(shape), np.zeros(shape)
            counts[node[own], c[own], b[own]], sums[node[own], c[own], b[own]] = n[own], total[own]
            grower.grow(counts, sums, categorical)
            if not n[held].sum() and len(grower.trees) >= rounds:  # nothing to validate on
                grower.best_at = len(grower.trees)
                grower.stop()
        behind = pending(growers)
        if max(map(len, behind)) > PENDING:
            now = stored(now.mapInArrow(lambda batches: add_task(batches, columns, behind), BLOCKS), "boost-blocks")
            for g, own in zip(growers, behind):
                g.stored += len(own)
    return whole, start, growers


def scored(whole: DataFrame, start: float | None, growers: list[Grower], columns: int) -> DataFrame:
    trees = [g.trees for g in growers]
    return whole.mapInArrow(lambda batches: score_task(batches, columns, start, trees), "y double, part int, f array<double>")


def boost(df: DataFrame, train, key: str, categories: list[str], numbers: list[str], y: str, settings: list[Boosting], rounds: int = 600, patience: int = 25, validation: float = 0.1, seed="boost") -> tuple[DataFrame, list[Grower]]:
    """(rows, growers): y, part (0 fitted, 1 validation, 2 the rest) and f, the prediction of each setting.

    train: the condition of training rows, of which a hash of the key sets the share `validation` aside.  Rows with a
    null y are left out.  Without training rows predictions are null.
    """
    whole, start, growers = grown(df, train, key, categories, numbers, y, settings, rounds, patience, validation, seed)
    return scored(whole, start, growers, len(categories) + len(numbers)), growers


def boost_sweep(df: DataFrame, train, key: str, categories: list[str], numbers: list[str], y: str, settings: list[Boosting], rounds: int = 600, patience: int = 25, validation: float = 0.1, seed="boost") -> DataFrame:
    """setting, trees (kept), n, r2, mae, and auc of y > 0, on the rows outside training."""
    whole, start, growers = grown(df, train, key, categories, numbers, y, settings, rounds, patience, validation, seed)
    rows = scored(whole.filter("held"), start, growers, len(categories) + len(numbers))
    names = F.array(*[F.lit(s.name) for s in settings])
    long = rows.select("y", F.posexplode("f").alias("k", "yhat")).select("y", "yhat", names[F.col("k")].alias("setting"), (F.col("y") > 0).cast("int").alias("up"))
    long = stored(long, "boost-scores")
    trees = df.sparkSession.createDataFrame([(g.setting.name, len(g.trees)) for g in growers], "setting string, trees int")
    return regression_metrics(long, "y", "yhat", ["setting"]).join(auc(long, "yhat", "up", ["setting"]), "setting").join(trees, "setting")
