"""Toxicity by a weighted finite-state pattern grammar.

A lexicon gives each token its symbols: W (any word), I (insult), T (threat), Y (address), N (negation), R (verb of
reported speech).  Five weighted transducers read a clause of symbols one after the other:

  negation   a hit within SCOPE words after N becomes a negated hit (mark -)
  reported   a hit in a clause with R, before or after it, becomes a reported hit (mark ")
  target     a hit within REACH words before or after Y becomes an addressed hit (mark y)
  insult     accepts insults of all marks, threat accepts threats; their arcs carry the weights

``compose`` joins them into one automaton once; the score of a clause is the weight of its best path (max-plus), and
the arcs of that path say which features the clause has.  A document's score is a logistic function of the features of
its clauses.  An address never weighs less than nothing and negation and reported speech never more (BOUNDS), so an addressed
insult always outweighs the same word alone, and that a negated or reported one.

The insult lexicon is learned from labelled rows: words, and stems of 4 to 8 letters, that cover toxic
documents and are absent from clean ones, chosen greedily by the documents they newly cover, and then all
others that so many toxic documents and no clean one show that FALSE of them at most do so by chance.  The weights of the arcs start from the grammar's own (PRIOR) and are fitted on the same
rows, best paths and weights in turn.  Fitting uses a bounded sample of labelled rows (TRAIN_DOCS), chosen by a hash
of the id, all of whose features are candidates; only words go into a score.

Defined cases: a null or empty text has no clause and gets the base rate's score; a null doc_id is not
held out; repeated rows get equal scores; without toxic labels the built-in lexicons alone score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices, stored

TRAIN_DOCS = 20_000
THRESHOLD = 0.3
#: Features that may enter the lexicon by chance, for each number of documents that show them.
FALSE = 0.5
#: Lengths of the stems that may stand for a family of words.
STEMS = (4, 5, 6, 7, 8)

# Fixed word lists of the grammar (the insult list is only a seed; see learn_lexicon).
INSULT = "idiot moron stupid loser scum".split()
THREAT = "kill murder hurt destroy strangle töten umbringen tuer massacrer matar destruir".split()
TARGET = "you your yours du dich dir dein sie ihr tu te toi vous votre tú ti usted ustedes vosotros".split()
NEGATION = "not never nor isn't aren't don't nicht kein keine nie ne pas jamais nunca jamás tampoco".split()
REPORTED = "said says told quoted claimed wrote called sagte sagt schrieb dit disait écrit dijo dice escribió".split()

FEATURES = ("insult", "threat", "addressed insult", "addressed threat", "negated", "reported")
#: Weights of the arcs before any label is seen, after the base weight of a document, and what fitting may make of them.
PRIOR = (-4.0, 3.0, 3.0, 1.0, 1.5, -2.0, -1.5)
BOUNDS = ((-9.0, 0.0), (0.5, 20.0), (0.5, 20.0), (0.3, 20.0), (0.3, 20.0), (-20.0, -0.3), (-20.0, -0.3))
SCOPE, REACH = 3, 4
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
HITS, CUES = ("I", "T"), ("W", "Y", "N", "R")


class Transducer:
    """arcs[state][input symbol] is a list of (output symbol, features, next state); state 0 is the first."""

    def __init__(self, waiting: tuple = ()):
        self.arcs: dict = {}
        self.waiting = set(waiting)  # states in which a clause may not end

    def arc(self, state, symbol: str, output: str, after, features: tuple[int, ...] = ()) -> None:
        self.arcs.setdefault(state, {}).setdefault(symbol, []).append((output, features, after))

    def accepts(self, state) -> bool:
        return state not in self.waiting


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that feeds what a writes to b; its states are the reachable pairs, numbered."""
    out, number, todo = Transducer(), {(0, 0): 0}, [(0, 0)]
    while todo:
        p, q = pair = todo.pop()
        if not (a.accepts(p) and b.accepts(q)):
            out.waiting.add(number[pair])
        for symbol, arcs in a.arcs.get(p, {}).items():
            for middle, f, p2 in arcs:
                for output, g, q2 in b.arcs.get(q, {}).get(middle, ()):
                    if (p2, q2) not in number:
                        number[p2, q2] = len(number)
                        todo.append((p2, q2))
                    out.arc(number[pair], symbol, output, number[p2, q2], f + g)
    return out


def negation(scope: int = SCOPE) -> Transducer:
    """State k: so many words of the scope are left."""
    t = Transducer()
    for k in range(scope + 1):
        for x in ("W", "Y", "R"):
            t.arc(k, x, x, max(0, k - 1))
        t.arc(k, "N", "N", scope)
        for x in HITS:
            t.arc(k, x, x + "-" if k else x, max(0, k - 1))
    return t


def reported(hits: list[str]) -> Transducer:
    """0: nothing yet, 1: a cue has come, 2: a hit that a cue must follow, 3: a hit that no cue may follow."""
    t = Transducer(waiting=(2,))
    for k in range(4):
        for x in ("W", "Y", "N"):
            t.arc(k, x, x, k)
    for k, after in ((0, 1), (1, 1), (2, 1)):
        t.arc(k, "R", "R", after)
    for x in hits:
        t.arc(0, x, x + '"', 2)
        t.arc(0, x, x, 3)
        t.arc(1, x, x + '"', 1)
        t.arc(2, x, x + '"', 2)
        t.arc(3, x, x, 3)
    return t


def target(hits: list[str], reach: int = REACH) -> Transducer:
    """State k > 0: the last address is reach - k words back; k < 0: a hit waits for one within -k words."""
    t = Transducer(waiting=tuple(range(-reach, 0)))
    for k in range(-reach, reach + 1):
        on = k - 1 if k > 0 else k + 1 if k < -1 else None if k == -1 else 0
        for x in ("W", "N", "R"):
            if on is not None:
                t.arc(k, x, x, on)
        t.arc(k, "Y", "Y", reach)
        for x in hits:
            if k > 0:
                t.arc(k, x, x + "y", on)
            elif k == 0:
                t.arc(0, x, x, 0)
                t.arc(0, x, x + "y", -reach)
            elif on is not None:
                t.arc(k, x, x + "y", on)
    return t


def accepted(letter: str, base: int, addressed: int, symbols: list[str]) -> Transducer:
    """Weighs the hits of a letter by their marks and passes all else on."""
    t = Transducer()
    for x in symbols:
        if x[0] != letter:
            t.arc(0, x, x, 0)
        else:
            marks = (addressed,) * ("y" in x) + (4,) * ("-" in x) + (5,) * ('"' in x)
            t.arc(0, x, "W", 0, (base, *marks))
    return t


def grammar_automaton() -> Transducer:
    marked = [h + a for h in HITS for a in ("", "-")]
    quoted = [h + a for h in marked for a in ("", '"')]
    all_hits = [h + a for h in quoted for a in ("", "y")]
    out = compose(compose(negation(), reported(marked)), target(quoted))
    out = compose(out, accepted("I", 0, 2, [*CUES, *all_hits]))
    return compose(out, accepted("T", 1, 3, [*CUES, *(h for h in all_hits if h[0] == "T")]))


AUTOMATON = grammar_automaton()


class Grammar:
    def __init__(self, words: dict[str, float], stems: dict[str, float], weights: np.ndarray | None = None):
        self.words, self.stems = words, stems
        self.cues: dict[str, str] = {}
        for letter, some in (("T", THREAT), ("Y", TARGET), ("N", NEGATION), ("R", REPORTED)):
            for w in some:
                self.cues[w] = self.cues.get(w, "") + letter
        self.weights = np.array(PRIOR if weights is None else weights, float)
        self.best: dict[tuple[str, ...], tuple[int, ...]] = {}

    def label(self, token: str) -> str:
        """The symbols of a token, one letter each; empty at the end of a clause."""
        if token in ".!?;:\n":
            return ""
        hit = token in self.words or any(token[:n] in self.stems for n in STEMS if len(token) > n)
        return ("I" if hit else "") + self.cues.get(token, "") or "W"

    def best_path(self, clause: tuple[str, ...]) -> tuple[int, ...]:
        """How often the best path of a clause uses each feature."""
        gain = self.weights[1:].tolist()
        front = {0: (0.0, (0,) * len(FEATURES))}
        for symbols in clause:
            ahead: dict = {}
            for state, (weight, used) in front.items():
                arcs = AUTOMATON.arcs.get(state, {})
                for symbol in symbols:
                    for _, features, after in arcs.get(symbol, ()):
                        w = weight + sum([gain[f] for f in features])
                        n = tuple([u + features.count(f) for f, u in enumerate(used)]) if features else used
                        if after not in ahead or (w, n) > ahead[after]:
                            ahead[after] = (w, n)
            front = ahead
        return max((x for state, x in front.items() if AUTOMATON.accepts(state)), default=(0.0, (0,) * len(FEATURES)))[1]

    def clauses(self, text: str, memo: dict[str, str]) -> list[int]:
        """Uses of each feature on the best paths of the clauses that hold a hit, and the number of these clauses."""
        symbols = []
        for token in TOKEN.findall(text.lower()):
            s = memo.get(token)
            if s is None:
                if len(memo) > 400_000:
                    memo.clear()
                s = memo[token] = self.label(token)
            symbols.append(s)
        found = [0] * (len(FEATURES) + 1)
        hits = [i for i, s in enumerate(symbols) if s and s[0] in HITS]
        done = -1
        for i in hits:
            if i < done:
                continue
            start = i
            while start and symbols[start - 1]:
                start -= 1
            try:
                done = symbols.index("", i)
            except ValueError:
                done = len(symbols)
            for k, n in enumerate(self.path_of(tuple(symbols[start:done]))):
                found[k] += n
            found[-1] += 1
        return found

    def path_of(self, clause: tuple[str, ...]) -> tuple[int, ...]:
        got = self.best.get(clause)
        if got is None:
            got = self.best_path(clause)
            if len(clause) < 64:
                if len(self.best) > 100_000:
                    self.best.clear()
                self.best[clause] = got
        return got

    def score(self, found: list[int]) -> float:
        z = self.weights[0] + sum(w * math.log1p(x) for w, x in zip(self.weights[1:], found) if x)
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))


def document_features(text: str) -> set[str]:
    """Words as they are, stems with a trailing hyphen."""
    words = {t for t in TOKEN.findall(text.lower()) if t not in ".!?;:\n"}
    return words | {w[:n] + "-" for w in words for n in STEMS if len(w) > n}


def counted_features(batches):
    """(feature, toxic documents, clean documents) of a partition."""
    toxic, clean = Counter(), Counter()

    def flush():
        keys = list(toxic | clean)
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], names=["feature", "toxic", "clean"])
        toxic.clear()
        clean.clear()
        return out

    for batch in slices(batches):
        for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            (toxic if y else clean).update(document_features(text or ""))
        if len(toxic) + len(clean) > 300_000:
            yield flush()
    yield flush()


def learn_lexicon(rows: DataFrame, n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Greedy cover of the toxic documents of rows by features that clean documents lack."""
    counts = stored(rows.mapInArrow(counted_features, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-features")
    good = counts.filter(f"toxic >= 3 and clean * {n_toxic} * 25 <= toxic * {n_clean}").withColumn("ratio", F.expr(f"ln((toxic + 0.5) / {n_toxic + 1}) - ln((clean + 0.5) / {n_clean + 1})"))
    table = good.orderBy("feature").toArrow().to_pylist()  # no more than the sampled documents hold
    known = {r["feature"]: r for r in table}

    def hits(batches):
        for batch in slices(batches):
            found = [sorted(document_features(t or "") & known.keys()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["found"])

    docs = [set(r["found"]) for r in rows.filter("toxic = 1").mapInArrow(hits, "found array<string>").toArrow().to_pylist()]
    p = n_toxic / (n_toxic + n_clean)
    chosen: dict[str, float] = {}
    open_docs = [d for d in docs if d]
    while open_docs:
        cover = Counter(f for d in open_docs for f in d)
        # Of features that cover as much, the one with most support, and then the longest, is the most specific.
        feature, n = max(cover.items(), key=lambda kv: (kv[1], known[kv[0]]["toxic"] - 20 * known[kv[0]]["clean"], len(kv[0]), kv[0]))
        if n < max(3, 0.004 * n_toxic):
            break
        chosen[feature] = known[feature]["ratio"]
        open_docs = [d for d in open_docs if feature not in d]
    shown = {r["n"]: r["features"] for r in counts.groupBy((F.col("toxic") + F.col("clean")).alias("n")).agg(F.count("*").alias("features")).collect()}
    for feature, r in known.items():
        if r["clean"] == 0 and shown[r["toxic"]] * p ** r["toxic"] <= FALSE:
            chosen.setdefault(feature, r["ratio"])
    return {f: w for f, w in chosen.items() if f[-1] != "-"}, {f[:-1]: w for f, w in chosen.items() if f[-1] == "-"}


def fit_weights(x: np.ndarray, y: np.ndarray, l2: float = 2.0) -> np.ndarray:
    """Logistic regression with a pull towards the grammar's own weights, by Newton steps kept inside BOUNDS."""
    prior, (low, high) = np.array(PRIOR), np.array(BOUNDS).T
    w = prior.copy()
    pull = np.full(len(w), l2)
    pull[0] = 0.01
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pull * (w - prior)
        free = ~((w <= low) & (g > 0) | (w >= high) & (g < 0))
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], g[free])
        after = np.clip(w - np.clip(step, -2, 2), low, high)
        if np.abs(after - w).max() < 1e-8:
            break
        w = after
    return w


def fit_grammar(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Grammar:
    known = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id"), 4))
    n = known.count()
    plain = Grammar(dict.fromkeys(INSULT, 1.0), {})
    if not n:
        return plain
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, train_docs / n) * (1 << 20)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    # Copies and near copies of one text would lend its rare words false support: of texts with one minimum hash of
    # their three-word windows, for either of two hashes, one stays.
    for seed in (1, 2):
        least = F.expr(f"array_min(transform(sequence(0, greatest(size(w) - 3, 0)), i -> xxhash64({seed}, get(w, i), get(w, i + 1), get(w, i + 2))))")
        rows = rows.withColumn("w", F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))
        rows = rows.groupBy(least.alias("least")).agg(F.min_by("text", "doc_id").alias("text"), F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    rows = stored(rows, "toxic-train")
    by_class = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = by_class.get(1, 0), by_class.get(0, 0)
    if not n_toxic or not n_clean:
        return plain
    words, stems = learn_lexicon(rows, n_toxic, n_clean)
    grammar = Grammar({**dict.fromkeys(INSULT, 1.0), **words}, stems)

    for _ in range(2):  # best paths under the weights, weights under the best paths

        def clauses(batches):
            memo: dict[str, str] = {}
            for batch in slices(batches):
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([grammar.clauses(t or "", memo)[:-1] for t in batch.column("text").to_pylist()], pa.list_(pa.int64()))], names=["toxic", "found"])

        got = rows.mapInArrow(clauses, "toxic int, found array<bigint>").groupBy("toxic", "found").count().orderBy("toxic", "found").toArrow().to_pylist()
        x = np.array([[1.0, *np.log1p(r["found"])] for r in got])
        k = np.array([r["count"] for r in got])
        grammar = Grammar(grammar.words, grammar.stems, fit_weights(np.repeat(x, k, 0), np.repeat([r["toxic"] for r in got], k)))
    return grammar


def toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_clauses (those with a hit)."""

    def run(batches):
        memo: dict[str, str] = {}
        for batch in slices(batches):
            found = [grammar.clauses(t or "", memo) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([grammar.score(x) for x in found], pa.float64()), pa.array([x[-1] for x in found], pa.int64())], names=["doc_id", "score", "n_clauses"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double, n_clauses long")
    return scored.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_clauses")
