"""Language of words and documents by a linear-chain conditional random field.

Every word (a run of letters) is a position of the chain, every language a state.  A position's score sums learned
weights of its affixes and inner n-grams of one to four bytes (hashed, the word's ends marked) and of its entry in a
lexicon; transitions between languages are learned too, on windows of which half are spliced from two documents, so
that text that switches languages mid-way is labelled word by word.  Forward-backward gives each word's posterior;
the document's language is the one with the largest sum over all its words, its score that sum's share.

Chains are cut into windows whose transfer matrices are multiplied together, so that long texts are worked out for many
windows at once and exactly as one chain.  The model is trained in numpy on a bounded sample of labelled documents
(TRAIN_DOCS documents, WINDOWS windows of WINDOW words of each).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices

#: Documents of the training sample over all languages, with FEWEST of each language at least where it has them.
TRAIN_DOCS, FEWEST = 4000, 20
#: Windows of each sampled document, spread over the whole text; words of a window; bytes of a word in training.
WINDOWS, WINDOW, WORD_BYTES = 3, 32, 64
#: Hashed n-gram features, longest n-gram, words of the lexicon and occurrences that bring a word into it.
HASHES, ORDER, LEXICON, SEEN = 1 << 16, 4, 1 << 15, 3
STEPS, RATE, DECAY = 40, 0.25, 2e-6
#: Words of a window when scoring, bytes worked on at a time; a word over a piece counts as several.
CHAIN, PIECE = 64, 1 << 19
UNDETERMINED = "und"

#: Letters stay (any byte of a character outside ASCII, and the apostrophe), all else parts words.
PARTS = bytes(b if chr(b).isalpha() and b < 128 or b >= 128 or b == 39 else 32 for b in range(256))
LETTER = re.compile(r"[^\W\d_]")
POWERS = np.cumprod(np.full(WORD_BYTES, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def letters_of(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass").translate(PARTS)


def word_features(piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the words of a piece that begins and ends with a space; each word's first place in the table of n-grams;
    that table (a column for each order; HASHES where there is none); hashes of the whole words."""
    b = np.frombuffer(piece, np.uint8)
    letter = b != 32
    starts = word_starts(piece)
    table = np.full((len(b), ORDER), HASHES, np.int32)
    h = b.astype(np.uint32)
    for n in range(1, ORDER + 1):
        if n > 1:
            h = h[:-1] * np.uint32(0x01000193) + b[n - 1 :]
        inner = letter[: len(b) - n + 1].copy() if n == 1 else letter[: len(b) - n + 1] | letter[n - 1 :]
        for k in range(1, n - 1):
            inner &= letter[k : len(b) - n + 1 + k]
        mixed = (h + np.uint32(n)) * np.uint32(0x85EBCA6B)
        table[: len(h), n - 1][inner] = ((mixed >> np.uint32(16)) % HASHES)[inner]
    place = np.arange(len(b)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(b)]])))
    whole = np.where(letter, b.astype(np.uint64) * POWERS[place % WORD_BYTES], np.uint64(0))
    hashes = np.add.reduceat(whole, starts) if len(starts) else np.zeros(0, np.uint64)
    return starts, starts - 1, table, hashes


def passes(x: np.ndarray, lengths: np.ndarray, moves: np.ndarray, enter: np.ndarray, leave: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward vectors, each scaled to sum 1, of chains side by side.

    x: (steps, chains, states) emission factors; enter: the vector before the first step (of a chain's very first
    window it is the prior, which no transition precedes: `first`); leave: what follows the last step.
    """
    steps, chains, states = x.shape
    ahead, behind = np.empty_like(x), np.empty_like(x)
    v = enter
    for t in range(steps):
        moved = v @ moves
        if t == 0:
            moved = np.where(first[:, None], v, moved)
        moved = moved * x[t]
        moved /= moved.sum(axis=1, keepdims=True)
        v = ahead[t] = np.where((t < lengths)[:, None], moved, v)
    v = leave
    for t in range(steps - 1, -1, -1):
        inside = (t < lengths)[:, None]
        behind[t] = v
        moved = (v * x[t]) @ moves.T
        moved /= moved.sum(axis=1, keepdims=True)
        v = np.where(inside, moved, v)
    return ahead, behind


def posteriors(x: np.ndarray, lengths: np.ndarray, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
    p = ahead * behind
    p /= p.sum(axis=2, keepdims=True)
    return np.where((np.arange(len(x))[:, None] < lengths)[:, :, None], p, 0)


@dataclass
class LanguageField:
    langs: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    entries: np.ndarray
    moves: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    def emissions(self, piece: bytes) -> np.ndarray:
        """Scores of the words of a piece: (words, languages)."""
        starts, at, table, hashes = word_features(piece)
        if not len(starts):
            return np.zeros((0, len(self.langs)), np.float32)
        total = self.grams[table[:, 0]]
        for n in range(1, ORDER):
            total += self.grams[table[:, n]]
        return np.add.reduceat(total, at, axis=0) + self.entries[self.places(hashes)]

    def places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == hashes, at, len(self.lexicon))

    def word_posteriors(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text, the posterior of each language at each word."""
        found, counts = [], []
        for group in grouped(texts):
            scores, held = [], []
            for letters in group:
                own = [self.emissions(p) for _, p in pieces(letters)]
                held.append(sum(map(len, own)))
                scores += own
            found.append(self.chain(np.concatenate(scores), np.array(held)))
            counts += held
        flat = np.concatenate(found) if found else np.zeros((0, len(self.langs)))
        return np.split(flat, np.cumsum(counts)[:-1]) if counts else []

    def totals(self, letters: list[bytes]) -> np.ndarray:
        """Of each text (as letters_of gives it) the sums of its words' posteriors, all texts side by side."""
        blob = b" " + b" ".join(letters) + b" "
        ends = np.cumsum([len(b) + 1 for b in letters])
        scores, owners = [], []
        for at, piece in pieces(blob):
            owners.append(np.searchsorted(ends, word_starts(piece) + at - 1, side="right"))
            scores.append(self.emissions(piece))
        e, owner = np.concatenate(scores), np.concatenate(owners)
        out = np.zeros((len(letters), len(self.langs)))
        if len(e):
            np.add.at(out, owner, self.chain(e, np.bincount(owner, minlength=len(letters))))
        return out

    def chain(self, e: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Posteriors of the words of chains that stand one after the other, counts[i] words in chain i."""
        if not len(e):
            return e
        states = e.shape[1]
        e = np.exp(np.maximum(e - e.max(axis=1, keepdims=True), -60)).astype(np.float64)
        moves = np.exp(self.moves - self.moves.max()).astype(np.float64)
        begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
        per = -(-counts // CHAIN)
        chain_of = np.repeat(np.arange(len(counts)), per)
        rank = np.arange(len(chain_of)) - np.repeat(np.cumsum(per) - per, per)
        start = begins[chain_of] + rank * CHAIN
        lengths = np.minimum(CHAIN, begins[chain_of] + counts[chain_of] - start)
        rows = np.minimum(start[None, :] + np.arange(lengths.max())[:, None], len(e) - 1)
        x = e[rows]
        windows = len(start)
        enter, leave, first = np.full((windows, states), 1 / states), np.full((windows, states), 1 / states), rank == 0
        if per.max() > 1:
            many = np.flatnonzero(per[chain_of] > 1)
            m = np.tile(np.eye(states), (len(many), 1, 1))
            for t in range(len(x)):
                step = m @ moves
                if t == 0:
                    step = np.where(first[many][:, None, None], m, step)
                step = step * x[t][many][:, None, :]
                step /= step.sum(axis=(1, 2), keepdims=True)
                m = np.where((t < lengths[many])[:, None, None], step, m)
            where = np.full(windows, -1)
            where[many] = np.arange(len(many))
            by_rank = split_by(rank[many], many)
            for own in by_rank[:-1]:
                own = own[rank[own] + 1 < per[chain_of[own]]]
                v = (enter[own][:, None, :] @ m[where[own]])[:, 0]
                enter[own + 1] = v / v.sum(axis=1, keepdims=True)
            for own in by_rank[:0:-1]:
                v = (m[where[own]] @ leave[own][:, :, None])[:, :, 0]
                leave[own - 1] = v / v.sum(axis=1, keepdims=True)
        ahead, behind = passes(x, lengths, moves, enter, leave, first)
        p = posteriors(x, lengths, ahead, behind)
        out = np.empty((len(e), states))
        inside = np.arange(len(x))[:, None] < lengths
        out[rows[inside]] = p[inside]
        return out


def split_by(rank: np.ndarray, what: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(rank, kind="stable")
    return np.split(what[order], np.flatnonzero(np.diff(rank[order])) + 1)


def word_starts(piece: bytes) -> np.ndarray:
    letter = np.frombuffer(piece, np.uint8) != 32
    return np.flatnonzero(letter[1:] & ~letter[:-1]) + 1


def grouped(texts: list[str]) -> Iterator[list[bytes]]:
    for at in range(0, len(texts), 256):
        yield [b" " + letters_of(t) + b" " for t in texts[at : at + 256]]


def pieces(blob: bytes) -> Iterator[tuple[int, bytes]]:
    """The blob in pieces of about PIECE bytes that begin and end with a space (the one between two pieces is in both), with their places."""
    if len(blob) <= PIECE:
        yield 0, blob
        return
    at = 0
    while at < len(blob) - 1:
        end = min(at + PIECE, len(blob) - 1)
        cut = blob.rfind(b" ", at + 1, end + 1)
        if cut <= at:  # one word over the whole piece
            yield at, b" " + blob[at + 1 : end] + b" "
            at = end - 1
        else:
            yield at, blob[at : cut + 1]
            at = cut


def sample_windows(docs: DataFrame) -> DataFrame:
    """(lang, words) windows of the sampled training documents; the sample of a language is chosen by a hash of its rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 4))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    each = max(FEWEST, TRAIN_DOCS // max(1, len(counts)))
    cells = [v for k, n in counts.items() for v in (F.lit(k), F.lit(int(min(1.0, each / n) * (1 << 30))))]
    if not cells:
        return rows.select("lang", F.array(F.lit("")).alias("words")).limit(0)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30)) < F.create_map(*cells)[F.col("lang")])

    def cut(batches):
        for batch in slices(batches):
            langs, found = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = letters_of(text).split()
                n = -(-len(words) // WINDOW)
                for k in sorted({i * n // WINDOWS for i in range(WINDOWS)} if n else ()):
                    langs.append(lang)
                    found.append([w[:WORD_BYTES] for w in words[k * WINDOW : (k + 1) * WINDOW]])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.list_(pa.binary()))], ["lang", "words"])

    return chosen.mapInArrow(cut, "lang string, words array<binary>")


def spliced(windows: list[tuple[int, list[bytes]]], seed: int = 7) -> list[tuple[list[int], list[bytes]]]:
    """Half of the windows as they are; of the others the first half of one and the second half of another."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(windows))
    out = [([y] * len(w), w) for y, w in (windows[k] for k in order[: len(order) // 2])]
    rest = [windows[k] for k in order[len(order) // 2 :]]
    for (y, v), (z, w) in zip(rest, rest[1:] + rest[:1]):
        a, b = len(v) // 2, len(w) // 2
        out.append(([y] * a + [z] * (len(w) - b), v[:a] + w[b:]))
    return [s for s in out if s[0]]


def train(langs: list[str], windows: list[tuple[int, list[bytes]]]) -> LanguageField:
    """Penalised maximum likelihood of the label sequences, by Adam with whole gradients."""
    sequences = spliced(windows)
    names: dict[bytes, int] = {}
    ids = [[names.setdefault(w, len(names)) for w in ws] for _, ws in sequences]
    states, steps, n = len(langs), max(map(len, ids)), len(ids)
    lengths = np.array(list(map(len, ids)))
    inside = np.arange(steps)[:, None] < lengths
    word, label = np.zeros((steps, n), np.int64), np.zeros((steps, n), np.int64)
    for k, (ws, (ys, _)) in enumerate(zip(ids, sequences)):
        word[: len(ws), k], label[: len(ws), k] = ws, ys
    _, at, table, hashes = word_features(b" " + b" ".join(names) + b" ")
    seen = np.bincount(word[inside], minlength=len(names))
    often = np.flatnonzero(seen >= SEEN)
    lexicon = np.unique(hashes[often[np.argsort(-seen[often], kind="stable")][:LEXICON]])
    found = LanguageField(langs, np.zeros((HASHES + 1, states), np.float32), lexicon, np.zeros((len(lexicon) + 1, states), np.float32), np.zeros((states, states), np.float32))
    entry = found.places(hashes)
    segment = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(table))))
    truth = np.zeros((steps, n, states))
    np.put_along_axis(truth, label[:, :, None], 1.0, axis=2)
    truth *= inside[:, :, None]
    pairs = inside[1:]
    true_moves = np.zeros((states, states))
    np.add.at(true_moves, (label[:-1][pairs], label[1:][pairs]), 1)
    even, first = np.full((n, states), 1 / states), np.ones(n, bool)
    params = [found.grams, found.entries, found.moves]
    first_moment, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total = inside.sum()
    for step in range(1, STEPS + 1):
        sums = found.grams[table].sum(axis=1)
        e = (np.add.reduceat(sums, at, axis=0) + found.entries[entry])[word]
        x = np.exp(e - e.max(axis=2, keepdims=True)).astype(np.float64)
        moves = np.exp(found.moves - found.moves.max()).astype(np.float64)
        ahead, behind = passes(x, lengths, moves, even, even, first)
        p = posteriors(x, lengths, ahead, behind)
        both = np.einsum("tni,tnj->tnij", ahead[:-1], x[1:] * behind[1:]) * moves
        both /= both.sum(axis=(2, 3), keepdims=True)
        rest = (p - truth)[inside]
        by_word = np.stack([np.bincount(word[inside], rest[:, s], len(names)) for s in range(states)], axis=1)
        flat, spread = table.ravel(), np.repeat(segment, ORDER)
        grads = [
            np.stack([np.bincount(flat, by_word[spread, s], HASHES + 1) for s in range(states)], axis=1),
            np.stack([np.bincount(entry, by_word[:, s], len(lexicon) + 1) for s in range(states)], axis=1),
            both[pairs].sum(axis=0) - true_moves,
        ]
        rate = RATE * (1 - (step - 1) / STEPS)
        for k, g in enumerate(grads):
            g = g / total + DECAY * params[k]
            first_moment[k] += 0.1 * (g - first_moment[k])
            second[k] += 0.05 * (g * g - second[k])
            params[k] -= (rate * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.95**step)) + 1e-7)).astype(np.float32)
        found.grams[HASHES] = 0
        found.entries[-1] = 0
    return found


def fit_languages(docs: DataFrame) -> LanguageField | None:
    """Fits on the sample; None where no document of the training share has a language and a word."""
    got = sample_windows(docs).toArrow().to_pylist()
    got = sorted((r["lang"], r["words"]) for r in got if r["words"])
    if not got:
        return None
    langs = sorted({lang for lang, _ in got})
    return train(langs, [(langs.index(lang), words) for lang, words in got])


def language_ids(docs: DataFrame, model: LanguageField | None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (the share of its words' posteriors that the language has).

    Nulls: a null text and a text without a letter are `und` with score 0, as is every text where the model is None;
    a null doc_id is scored like any other and not held out.  Ties between languages go to the smaller name.
    Very long texts are scored whole; a single word over PIECE bytes counts as several.  Repeated rows get equal
    results; an empty table gives no rows.  Other columns, whatever their names, are not read.
    """

    def run(batches):
        for batch in slices(batches, 512):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            known = [model is not None and LETTER.search(t) is not None for t in texts]
            pred, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            at = [k for k, ok in enumerate(known) if ok]
            if at:
                sums = model.totals([letters_of(texts[k]) for k in at])
                for k, row in zip(at, sums):
                    if row.sum() > 0:
                        best = int(row.argmax())
                        pred[k], score[k] = model.langs[best], min(1.0, float(row[best] / row.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long"), 4).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, model: LanguageField) -> DataFrame:
    """Per document: doc_id, words and the language of each word (the largest posterior), for text that switches languages."""

    def run(batches):
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            labels = [[model.langs[k] for k in p.argmax(axis=1)] for p in model.word_posteriors(texts)]
            words = [[w.decode("utf-8", "replace") for w in letters_of(t).split()] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.string()))], ["doc_id", "words", "langs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, words array<string>, langs array<string>")
