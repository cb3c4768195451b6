"""Quality rules: a linear-chain conditional random field labels the lines of a text as content or
boilerplate (Viterbi decoding); the share of words on content lines decides whether the text stays.

The field is trained here, in numpy, on windows of WINDOW lines of a bounded sample of labelled documents (TRAIN_DOCS
documents, TRAIN_WINDOWS windows).  Labels are known for documents only, so the labels of lines are latent: a good document may
hold boilerplate and a bad one content.  Expectation-maximisation finds them: a logistic model of single lines is
fitted to the lines' posteriors, which start from the document's label (PRIOR) and are tilted by it each round.  The
field is then fitted to these windows and to as many composed ones, in which runs of boilerplate lines of some
documents stand between content lines of others and the other way round, so that it learns where labels change.  The cut-off on the
content share is the one that serves the sampled documents best.  Without labels (or with one class only) every
text that passes the base rules stays.

Base rules: fewer than 50 words, or over half of the words in 3-word windows that occur twice.

Defined cases: a null or empty text has no words and fails the base rules; a row with a null doc_id is
scored like any other; repeated rows get equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, slices

TRAIN_DOCS = 4000
WINDOW, TRAIN_WINDOWS = 64, 8000
#: Chance that a line is boilerplate, before it is seen, in a good and in a bad document.
PRIOR = (0.1, 0.7)
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50

LINK = re.compile(rb"https?://|www\.|@\w|</?\w+>")
NOTICE = re.compile(rb"copyright|licen[sc]e|all rights reserved|cookie|subscribe|click here|\xc2\xa9")
#: Edges of the bins of each graded feature of a line.
EDGES = {
    "words": (1, 2, 4, 8, 16, 64),
    "symbols per word": (0.02, 0.1, 0.3, 0.7),
    "exclamations per word": (0.05, 0.2, 0.5),
    "share of capitals": (0.1, 0.3, 0.6),
    "share of digits": (0.05, 0.2, 0.5),
    "distinct share of words": (0.2, 0.4, 0.6),
    "bytes per word": (2.5, 4, 8, 12),
}
FLAGS = ("bias", "earlier line", "bars", "ends a sentence", "link", "notice", "first")
WIDTH = len(FLAGS) + sum(len(e) + 1 for e in EDGES.values())


def line_features(lines: list[bytes]) -> list[list[int]]:
    """The numbers of the features that hold, for each line that has a word."""
    out, seen = [], set()
    for line in lines:
        words = line.split()
        if not words:
            continue
        n, size = len(words), len(line)
        key = b" ".join(words)
        on = [0]
        if key in seen:
            on.append(1)
        seen.add(key)
        if line.count(b" | ") >= 2:
            on.append(2)
        if words[-1][-1:] in b".?!:\"'":
            on.append(3)
        low = line.lower()
        if LINK.search(low):
            on.append(4)
        if NOTICE.search(low):
            on.append(5)
        if not out:
            on.append(6)
        letters = max(1, size - line.count(b" "))
        graded = (
            n,
            (size - len(line.translate(None, SYMBOLS))) / n,
            line.count(b"!") / n,
            (size - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / letters,
            (size - len(line.translate(None, b"0123456789"))) / letters,
            len(set(words)) / n if n >= 8 else 1.0,
            letters / n,
        )
        at = len(FLAGS)
        for value, edges in zip(graded, EDGES.values()):
            on.append(at + sum(value >= e for e in edges))
            at += len(edges) + 1
        out.append((on, n))
    return out


def text_features(text: bytes):
    found = line_features(text.split(b"\n"))
    return [on for on, _ in found], [n for _, n in found]


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, WHITE).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.translate(None, WHITE)]
    repeated = 0
    if n >= 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        pairs = ids[:-1] * len(number) + ids[1:]
        if len(number) > 2_000_000:
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, where, counts = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = counts[where] >= 2
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


class Field:
    """A linear chain with two labels: 0 content, 1 boilerplate."""

    def __init__(self, emit: np.ndarray, move: np.ndarray, cut: float):
        self.emit, self.move, self.cut = emit, move, cut  # (WIDTH, 2), (2, 2), least share of content words

    def lines(self, features: list[list[int]]) -> list[int]:
        """The best labelling (Viterbi)."""
        if not features:
            return []
        (aa, ab), (ba, bb) = self.move.tolist()
        emit0, emit1 = self.emit[:, 0].tolist(), self.emit[:, 1].tolist()
        a = b = 0.0
        back = []
        for k, on in enumerate(features):
            x, y = sum([emit0[i] for i in on]), sum([emit1[i] for i in on])
            if k:
                from_a, from_b = a + aa < b + ba, a + ab < b + bb
                a, b = (b + ba if from_a else a + aa) + x, (b + bb if from_b else a + ab) + y
                back.append((from_a, from_b))
            else:
                a, b = x, y
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def content_share(self, text: bytes) -> float:
        features, words = text_features(text)
        labels = self.lines(features)
        total = sum(words)
        return sum(n for n, y in zip(words, labels) if not y) / total if total else 0.0


def log_add(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def chain_marginals(score: np.ndarray, move: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over padded chains: P(label) of each line and P(label, next label) of each step."""
    n, longest, _ = score.shape
    ahead = np.zeros((n, longest, 2))
    ahead[:, 0] = score[:, 0]
    for t in range(1, longest):
        ahead[:, t] = log_add(ahead[:, t - 1][:, :, None] + move[None], 1) + score[:, t]
    norm = log_add(ahead[np.arange(n), real.sum(1) - 1], 1)
    behind = np.zeros((n, longest, 2))
    for t in range(longest - 2, -1, -1):
        behind[:, t] = np.where(real[:, t + 1][:, None], log_add(move[None] + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0)
    one = np.exp(ahead + behind - norm[:, None, None]) * real[:, :, None]
    both = np.exp(ahead[:, :-1, :, None] + move[None, None] + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - norm[:, None, None, None]) * real[:, 1:, None, None]
    return one, both


def padded(sample: list[tuple[list[list[int]], list[int]]]):
    """(features, which lines are real, labels) of groups of sequences of like length."""
    sample = sorted((s for s in sample if s[0]), key=lambda s: len(s[0]))
    at = 0
    while at < len(sample):
        end = at
        while end < len(sample) and len(sample[end][0]) <= 2 * len(sample[at][0]) and end - at < 1024:
            end += 1
        part, longest = sample[at:end], len(sample[end - 1][0])
        x = np.zeros((len(part), longest, WIDTH), np.float32)
        real, labels = np.zeros((len(part), longest), bool), np.zeros((len(part), longest), np.int64)
        for i, (rows, ys) in enumerate(part):
            real[i, : len(rows)] = True
            labels[i, : len(rows)] = ys
            for t, on in enumerate(rows):
                x[i, t, on] = 1
        yield x, real, labels
        at = end


def train_field(sample: list[tuple[list[list[int]], list[int]]], rounds: int = 120, rate: float = 0.15, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam of label sequences given their lines' features."""
    groups = list(padded(sample))
    total = sum(real.sum() for _, real, _ in groups)
    emit, move = np.zeros((WIDTH, 2)), np.zeros((2, 2))
    state = [[np.zeros_like(w), np.zeros_like(w)] for w in (emit, move)]
    for k in range(1, rounds + 1):
        grads = [l2 * emit, l2 * move]
        for x, real, labels in groups:
            p, both = chain_marginals(x @ emit, move, real)
            n, longest = labels.shape
            p[np.arange(n)[:, None], np.arange(longest)[None], labels] -= real
            grads[0] = grads[0] + (x.reshape(-1, WIDTH).T @ p.reshape(-1, 2)) / total
            gold = np.zeros((2, 2))
            np.add.at(gold, (labels[:, :-1], labels[:, 1:]), real[:, 1:])
            grads[1] = grads[1] + (both.sum((0, 1)) - gold) / total
        for w, g, (m, v) in zip((emit, move), grads, state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return emit, move


def line_labels(windows: list[list[list[int]]], bad: list[int], rounds: int = 10) -> list[list[int]]:
    """Labels of single lines from those of documents, by expectation-maximisation with a logistic model of a line."""
    x = np.zeros((sum(map(len, windows)), WIDTH), np.float32)
    for i, on in enumerate(on for lines in windows for on in lines):
        x[i, on] = 1
    of_bad = np.repeat(np.array(bad, bool), [len(w) for w in windows])
    prior = np.where(of_bad, PRIOR[1], PRIOR[0])
    posterior = prior.copy()
    weights = np.zeros(WIDTH)
    for _ in range(rounds):
        for _ in range(8):  # Newton steps of the logistic model towards the posteriors
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(WIDTH), x.T @ (p - posterior) + weights)
            weights = weights - step
        base = min(max(posterior.mean(), 1e-3), 1 - 1e-3)
        odds = np.clip(x @ weights, -30, 30) + np.log(prior / (1 - prior)) - np.log(base / (1 - base))
        posterior = 1 / (1 + np.exp(-odds))
    flat, out = (posterior > 0.5).astype(int).tolist(), []
    for w in windows:
        out.append(flat[: len(w)])
        del flat[: len(w)]
    return out


def composed(sample: list[tuple[list[list[int]], list[int]]], seed: int = 11) -> list[tuple[list[list[int]], list[int]]]:
    """As many windows again, each with a run of up to four lines of the other label, from another window, put in."""
    rng = np.random.default_rng(seed)
    runs: tuple[list, list] = ([], [])
    for lines, ys in sample:
        at = 0
        for y, group in itertools.groupby(ys):
            n = len(list(group))
            runs[y].append(lines[at : at + n])
            at += n
    out = []
    for lines, ys in sample:
        y = 1 - int(2 * sum(ys) > len(ys))
        if not runs[y] or not lines:
            continue
        run = runs[y][rng.integers(len(runs[y]))]
        at, n = int(rng.integers(len(run))), int(rng.integers(1, 5))
        run, to = run[at : at + n], int(rng.integers(len(lines) + 1))
        out.append((lines[:to] + run + lines[to:], ys[:to] + [y] * len(run) + ys[to:]))
    return out


def fit_field(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_windows: int = TRAIN_WINDOWS) -> Field | None:
    """Fits on a sample of about train_docs labelled documents, chosen by a hash of the id, and no more than train_windows of their windows."""
    known = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    n = known.count()
    if not n:
        return None
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, train_docs / n) * (1 << 20)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def features(batches):
        for batch in slices(batches):
            found = []
            for quality, text in zip(batch.column("quality").to_pylist(), batch.column("text").to_pylist()):
                lines, words = text_features((text or "").encode())
                for at in range(0, len(lines), WINDOW):
                    found.append((quality, lines[at : at + WINDOW], words[at : at + WINDOW]))
            quality, lines, words = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(quality, pa.int32()), pa.array(lines, pa.list_(pa.list_(pa.int16()))), pa.array(words, pa.list_(pa.int32()))], names=["quality", "features", "words"])

    windows = rows.mapInArrow(features, "quality int, features array<array<smallint>>, words array<int>")
    got = windows.orderBy(F.xxhash64("features", "words"), "quality").limit(train_windows).toArrow().to_pylist()
    if len({r["quality"] for r in got}) < 2:
        return None
    got.sort(key=lambda r: (len(r["features"]), r["quality"], r["features"]))
    found = line_labels([r["features"] for r in got], [1 - r["quality"] for r in got])
    sample = [(r["features"], ys) for r, ys in zip(got, found)]
    field = Field(*train_field(sample + composed(sample)), 0.5)
    shares = [(sum(n for n, y in zip(r["words"], field.lines(r["features"])) if not y) / sum(r["words"]), r["quality"]) for r in got if sum(r["words"]) >= MIN_WORDS]
    cuts = [0.05 * k for k in range(1, 20)]
    best = [sum((s >= c) == bool(q) for s, q in shares) for c in cuts]
    top = [c for c, b in zip(cuts, best) if b == max(best)]
    field.cut = top[len(top) // 2] if shares else 0.5
    return field


OUT = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "content_share": pa.float64(), "kept": pa.bool_()}


def quality_rules(docs: DataFrame, field: Field | None) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, content_share, kept."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                text = (text or "").encode()
                n, chars, symbols, lines, repeated = base_counts(text)
                failed = n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n
                share = field.content_share(text) if field else 1.0
                rows.append((n, chars, symbols, lines, repeated, failed, share, not failed and (not field or share >= field.cut)))
            columns = list(zip(*rows)) or [()] * len(OUT)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, OUT.values()))], names=["doc_id", *OUT])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")


def keep_quality(docs: DataFrame, field: Field | None) -> DataFrame:
    """The rows of docs that stay, with their columns, in one pass over the texts."""

    def keeps(text):
        text = (text or "").encode()
        n, _, _, _, repeated = base_counts(text)
        if n < MIN_WORDS or 100 * repeated > MAX_REPEATED * n:
            return False
        return not field or field.content_share(text) >= field.cut

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([keeps(t) for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
