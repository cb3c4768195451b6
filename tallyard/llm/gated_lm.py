"""Language-model scoring with a gated recurrent network and a class-factored softmax.

Tokens are the words of [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end token a document.  Counts of
all training tokens are gathered in Spark.  The TOP most frequent tokens (of MIN_COUNT at least) are known to the tasks by name;
the others meet their counts in a join, so no table that grows with the corpus is broadcast.

P(token | past) = P(class | state) P(token | class, state).  The first NEURAL tokens by rank form classes of PER_CLASS whose
members the state chooses among; the further classes are bins of equal mass whose members share by count,
and the last class holds all rarer tokens and the unknown one, by count plus one.  The state is a gated recurrent
unit that reads a document from its start, window by window, the state carried over, so a document's score is
the log-likelihood of its complete text.

Training: truncated backpropagation in numpy (Adam) on all training documents.  They are dealt by a hash of id and
text to shards of about SHARD_TOKENS tokens; in each of ROUNDS rounds every shard trains from the common
weights, and the weights are averaged by tokens in a tree of groups.

Defined cases: a null or empty text is the end token alone; rows with a null doc_id train and are not held out;
repeated rows get equal scores; an empty table gives no rows.  Unknown tokens count as count 0.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, held_out, slices, stored

TOP = 1 << 18
#: Tokens that are rarer in training are no top tokens, so that the last class is trained on what unknown tokens are like.
MIN_COUNT = 3
NEURAL, PER_CLASS, CLASSES = 512, 64, 32
INPUTS = 2048
HIDDEN = 16
WINDOW = 16
#: Parallel streams of a shard: so many that each is about STREAM_TOKENS long, between these bounds.
STREAMS, MOST_STREAMS, STREAM_TOKENS = 64, 512, 6_250
SHARD_TOKENS = 3_200_000
ROUNDS = 2
RATE = 0.01
SCORE_TOKENS = 3_000_000
END = b"\n"  # no word has a line feed


def words(text: bytes) -> list[bytes]:
    return [*text.translate(LOWER).split(), END]


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The words of some texts, all at once: how many each text has, the number of each word, and the words by number."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(real)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    names = coded.dictionary
    raw, bounds = names.buffers()[2], np.frombuffer(names.buffers()[1] or b"", np.int32)[: len(names) + 1].tolist()
    raw = raw.to_pybytes() if raw else b""
    return np.diff(offsets), coded.indices.to_numpy(zero_copy_only=False), [raw[a:b] for a, b in zip(bounds, bounds[1:])]


def counted(batches):
    """(token, count) of a partition, merged in bounded memory."""
    counts: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])
        counts.clear()
        return out

    for batch in slices(batches, 1024):
        _, numbers, names = tokens_of(batch.column("text"))
        for name, n in zip(names, np.bincount(numbers, minlength=len(names)).tolist()):
            counts[name] += n
        counts[END] += batch.num_rows
        if len(counts) > 600_000:
            yield flush()
    yield flush()


class Vocabulary:
    """Ranks, classes and shares of the top tokens, and totals of the rest."""

    def __init__(self, top: list[tuple[bytes, int]], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.rank = {w: i for i, (w, _) in enumerate(top)}
        c = np.array([n for _, n in top], np.float64) + 1
        k = len(c)
        self.log_count = np.log(c)
        self.rest = float(total - (c - 1).sum()) + (distinct - k) + 1
        neural = min(NEURAL, k)
        classes = np.zeros(k + 1, np.int64)
        classes[:neural] = np.arange(neural) // PER_CLASS
        first = NEURAL // PER_CLASS
        if k > neural:
            mass = np.cumsum(c[neural:])
            classes[neural:k] = first + np.minimum((mass / mass[-1] * (CLASSES - 1 - first)).astype(np.int64), CLASSES - 2 - first)
        classes[k] = CLASSES - 1  # every token that is not among the top
        self.classes = classes
        self.neural = neural
        weight = np.bincount(classes[:k], c, CLASSES)
        weight[CLASSES - 1] = self.rest
        self.class_log = np.log(np.maximum(weight, 0.5) / np.maximum(weight, 0.5).sum())
        share = np.zeros(k + 1)  # natural log of the share inside the class; the join supplies it for the rest
        share[neural:k] = self.log_count[neural:] - np.log(weight[classes[neural:k]])
        self.share = share
        self.inputs = np.where(np.arange(k + 1) < INPUTS, np.arange(k + 1), INPUTS + classes)
        self.inputs[k] = INPUTS + CLASSES - 1

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        k = len(self.rank)
        get = self.rank.get
        return np.fromiter((get(t, k) for t in tokens), np.int32, len(tokens))

    def coded(self, texts: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
        """The ids of each text with its end token, and its tokens outside the top with their numbers."""
        lengths, numbers, names = tokens_of(texts)
        k, docs = len(self.rank), len(lengths)
        ids = self.ids(names)[numbers] if len(names) else np.zeros(0, np.int32)
        last = np.cumsum(lengths + 1) - 1
        whole = np.full(len(ids) + docs, self.rank.get(END, k), np.int32)
        inside = np.ones(len(whole), bool)
        inside[last] = False
        whole[inside] = ids
        rare = ids == k
        keys, times = np.unique(np.repeat(np.arange(docs), lengths)[rare] * max(1, len(names)) + numbers[rare], return_counts=True)
        owner, name = keys // max(1, len(names)), keys % max(1, len(names))
        if END not in self.rank:  # then the end token is rare itself
            owner, name, times = np.concatenate([owner, np.arange(docs)]), np.concatenate([name, np.full(docs, len(names))]), np.concatenate([times, np.ones(docs, np.int64)])
            order = np.argsort(owner, kind="stable")
            owner, name, times, names = owner[order], name[order], times[order], [*names, END]
        pairs = pa.StructArray.from_arrays([pa.array(names, pa.binary()).take(pa.array(name, pa.int64())), pa.array(times, pa.int32())], names=["token", "n"])
        return np.split(whole, last[:-1] + 1), pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(docs + 1)), pa.int32()), pairs)

    def weights(self) -> dict[str, np.ndarray]:
        """The network before training: it scores like the counts."""
        rng = np.random.default_rng(7)
        member = np.full((NEURAL // PER_CLASS, PER_CLASS), -30.0)
        member.reshape(-1)[: self.neural] = self.log_count[: self.neural]
        return {
            "gates": rng.normal(0, 0.3, (INPUTS + CLASSES, 3 * HIDDEN)).astype(np.float32),
            "turn": (rng.normal(0, 1, (HIDDEN, 3 * HIDDEN)) / math.sqrt(HIDDEN)).astype(np.float32),
            "class_w": np.zeros((HIDDEN, CLASSES), np.float32),
            "class_b": self.class_log.astype(np.float32),
            "member_w": np.zeros((NEURAL // PER_CLASS, HIDDEN, PER_CLASS), np.float32),
            "member_b": member.astype(np.float32),
        }


def pack(w: dict[str, np.ndarray]) -> bytes:
    return b"".join(v.astype(np.float32).tobytes() for v in w.values())


def unpack(data: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at, flat = {}, 0, np.frombuffer(data, np.float32)
    for k, v in like.items():
        out[k] = flat[at : at + v.size].reshape(v.shape).copy()
        at += v.size
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def advance(w: dict, x: np.ndarray, h: np.ndarray):
    """One step of the unit: the new state, and what backpropagation needs.  A column for each document, so that every part of a gate is one block of memory."""
    a = w["turn"].T @ h
    with np.errstate(over="ignore"):  # exp may reach infinity: a gate of 0
        zr = sigmoid(x[: 2 * HIDDEN] + a[: 2 * HIDDEN])
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        n = x[2 * HIDDEN :] + r * a[2 * HIDDEN :]
        n *= 2
        n = sigmoid(n)  # tanh(x) is 2 sigmoid(2 x) - 1
    n *= 2
    n -= 1
    return n + z * (h - n), (z, r, n, a[2 * HIDDEN :])


def powers(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The exponentials of the rows up to a factor for each row, in place, their sums, and the logarithm of each row's sum of exponentials."""
    top = x.max(initial=-np.inf)
    x -= top
    far = None
    if len(x) and x.min() < -60:  # rows that lie far below the others by themselves
        far = x.max(1, keepdims=True)
        x -= far
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    return x, total, np.log(total) + (top if far is None else top + far[:, 0])


def softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax of the rows, in place, and the logarithm of each row's sum of exponentials."""
    x, total, norm = powers(x)
    x /= total[:, None]
    return x, norm


def gradients(part: np.ndarray, state: np.ndarray, vocabulary: Vocabulary, w: dict[str, np.ndarray]):
    """A window of parallel streams (steps x streams ids) after state: loss in nats, gradients, the state after it."""
    wide, streams = part.shape
    H, n = HIDDEN, part.size
    ends = vocabulary.rank.get(END, -1)
    flat = part.reshape(-1)
    inputs, target = vocabulary.inputs[flat], vocabulary.classes[flat]
    x = np.take(w["gates"], inputs, axis=0, mode="clip").reshape(wide, streams, 3 * H)
    state, kept = np.ascontiguousarray(state.T), []
    hs = np.empty((H, n), np.result_type(x, state))
    goes_on = (part != ends).astype(hs.dtype)
    for t in range(wide):
        hs[:, t * streams : (t + 1) * streams] = state
        after, more = advance(w, np.ascontiguousarray(x[t].T), state)
        kept.append((state, *more))
        after *= goes_on[t]
        state = after
    hs = np.ascontiguousarray(hs.T)
    g = {}
    d = hs @ w["class_w"] + w["class_b"]
    rows = np.arange(n)
    loss = -float(d[rows, target].sum(dtype=np.float64))
    d, norm = softmax(d)
    loss += float(norm.sum(dtype=np.float64))
    d[rows, target] -= 1
    g["class_w"], g["class_b"] = hs.T @ d, np.ones(n, d.dtype) @ d
    dh = d @ w["class_w"].T
    inner = np.flatnonzero(flat < vocabulary.neural)
    inner = inner[np.argsort(target[inner], kind="stable")]
    of_class, member = hs[inner], flat[inner] % PER_CLASS
    back = np.empty_like(of_class)
    g["member_w"], g["member_b"] = np.zeros_like(w["member_w"]), np.zeros_like(w["member_b"])
    bounds = np.searchsorted(target[inner], np.arange(NEURAL // PER_CLASS + 1))
    for c, (a, b) in enumerate(zip(bounds, bounds[1:])):
        if a < b:
            d = of_class[a:b] @ w["member_w"][c] + w["member_b"][c]
            rows = np.arange(b - a)
            loss -= float(d[rows, member[a:b]].sum(dtype=np.float64))
            d, norm = softmax(d)
            loss += float(norm.sum(dtype=np.float64))
            d[rows, member[a:b]] -= 1
            g["member_w"][c], g["member_b"][c] = of_class[a:b].T @ d, np.ones(b - a, d.dtype) @ d
            back[a:b] = d @ w["member_w"][c].T
    dh[inner] += back
    carry = np.zeros_like(state)
    turned, last = np.empty((3 * H, n), dh.dtype), np.empty((H, n), dh.dtype)
    for t in range(wide - 1, -1, -1):
        before, z, r, m, am = kept[t]
        at = slice(t * streams, (t + 1) * streams)
        da = turned[:, at]
        carry *= goes_on[t]
        keep = carry * z
        carry -= keep
        m2 = m * m
        dm = np.multiply(carry, np.subtract(1, m2, out=m2), out=last[:, at])
        dz = np.subtract(before, m, out=m2)
        dz *= keep
        np.multiply(dz, 1 - z, out=da[:H])
        dmr = np.multiply(dm, r, out=da[2 * H :])
        dr = dmr * am
        np.multiply(dr, 1 - r, out=da[H : 2 * H])
        carry = w["turn"] @ da
        carry += keep
        carry += dh[at].T
    g["turn"] = (turned @ hs).T
    gates = np.empty((3 * H, len(w["gates"])), dh.dtype)
    for k, column in enumerate([*turned[: 2 * H], *last]):
        gates[k] = np.bincount(inputs, column, len(w["gates"]))
    g["gates"] = np.ascontiguousarray(gates.T)
    return loss, g, state.T


def train(docs: list[np.ndarray], vocabulary: Vocabulary, w: dict[str, np.ndarray], seed: int) -> dict[str, np.ndarray]:
    """One pass over the documents (ids with the end token) in parallel streams, windows of WINDOW steps.

    The last stream goes on with the first tokens, so that all have one length.
    """
    whole = np.concatenate(docs)
    streams = min(MOST_STREAMS, max(STREAMS, len(whole) // STREAM_TOKENS), max(1, len(whole) // WINDOW))
    steps = -(-len(whole) // streams)
    if not steps:
        return w
    ids = np.ascontiguousarray(np.resize(whole, (streams, steps)).T)
    state = np.zeros((streams, HIDDEN), np.float32)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    for k, at in enumerate(range(0, steps, WINDOW), 1):
        part = ids[at : at + WINDOW]
        _, g, state = gradients(part, state, vocabulary, w)
        for key in w:
            grad, one, two = g[key], first[key], second[key]
            grad *= 16 / part.size
            np.clip(grad, -1, 1, out=grad)
            one *= 0.9
            one += 0.1 * grad
            grad *= grad
            grad *= 0.01
            two *= 0.99
            two += grad
            step = np.sqrt(two / (1 - 0.99**k), out=grad)
            step += 1e-6
            np.divide(one, step, out=step)
            step *= RATE / (1 + k / 400) / (1 - 0.9**k)
            w[key] -= step
    return w


def likelihoods(docs: list[np.ndarray], vocabulary: Vocabulary, w: dict[str, np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each document (but for shares of tokens outside the top), all read side by side."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    lengths = np.array([len(docs[i]) for i in order])
    total = np.zeros(len(docs))
    state = np.zeros((len(docs), HIDDEN), np.float32)
    at, window = 0, 64
    while at < (lengths[0] if len(lengths) else 0):
        active = int(np.searchsorted(-lengths, -at, "left"))
        part = np.full((active, window), -1, np.int64)
        for row in range(active):
            piece = docs[order[row]][at : at + window]
            part[row, : len(piece)] = piece
        here = np.minimum(lengths[:active] - at, window)
        h, states, owners, tokens = state[:active].T.copy(), [], [], []
        for t in range(int(here[0])):
            n = int(np.searchsorted(-here, -t, "left"))
            h = h[:, :n]
            states.append(h.T)
            tokens.append(part[:n, t])
            owners.append(n)
            x = np.take(w["gates"], vocabulary.inputs[part[:n, t]], axis=0, mode="clip")
            h, _ = advance(w, np.ascontiguousarray(x.T), h)
            if n:
                state[:n] = h.T
        hs, flat = np.concatenate(states), np.concatenate(tokens)
        rows = np.concatenate([np.arange(n) for n in owners])
        classes = vocabulary.classes[flat]
        found = np.empty(len(flat))
        for a in range(0, len(flat), 16384):
            s = hs[a : a + 16384] @ w["class_w"] + w["class_b"]
            own = s[np.arange(len(s)), classes[a : a + 16384]]
            found[a : a + 16384] = own - powers(s)[2]
        found += vocabulary.share[flat]
        inner = np.flatnonzero(flat < vocabulary.neural)
        if len(inner):
            inner = inner[np.argsort(classes[inner], kind="stable")]
            bounds = np.searchsorted(classes[inner], np.arange(NEURAL // PER_CLASS + 1))
            for c in range(NEURAL // PER_CLASS):
                for a in range(bounds[c], bounds[c + 1], 16384):
                    some = inner[a : min(a + 16384, bounds[c + 1])]
                    s = hs[some] @ w["member_w"][c] + w["member_b"][c]
                    own = s[np.arange(len(s)), flat[some] % PER_CLASS]
                    found[some] += own - powers(s)[2]
        total[:active] += np.bincount(rows, found, active)
        at += window
    out = np.empty(len(docs))
    out[order] = total
    return out


CODED = "doc_key long, doc_id long, held_out boolean, shard long, ids binary, rare array<struct<token:binary,n:int>>"
SCORED = "doc_key long, doc_id long, n_tokens long, n_top long, log_top double, log_model double"


def dealt_rows(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Every row coded once, for training and scoring: ids (int32 of all its tokens), its rare tokens, and its shard by a hash of id and text."""
    shards = max(1, math.ceil(vocabulary.total / SHARD_TOKENS))

    def run(batches):
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            if batch.num_rows:
                ids, rare = vocabulary.coded(batch.column("text"))
                keys = np.arange(key + 1, key + batch.num_rows + 1)
                key += batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column("doc_id"), batch.column("held_out"), batch.column("shard"), pa.array([x.tobytes() for x in ids], pa.binary()), rare], names=["doc_key", "doc_id", "held_out", "shard", "ids", "rare"])

    rows = docs.select("doc_id", held_out(F.col("doc_id"), 7).alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).alias("shard"), "text")
    return rows.mapInArrow(run, CODED)


def score_rows(vocabulary: Vocabulary, w: dict[str, np.ndarray]):
    def run(batches):
        k = len(vocabulary.rank)
        held, docs, size = [], [], 0

        def flush():
            found, at = likelihoods(docs, vocabulary, w), 0
            for keys, doc_ids in held:
                n = len(doc_ids)
                part = docs[at : at + n]
                tops = [ids[ids < k] for ids in part]
                columns = [pa.array([len(x) for x in part], pa.int64()), pa.array([len(t) for t in tops], pa.int64()), pa.array([float(vocabulary.log_count[t].sum()) for t in tops], pa.float64()), pa.array(found[at : at + n])]
                yield pa.RecordBatch.from_arrays([keys, doc_ids, *columns], names=["doc_key", "doc_id", "n_tokens", "n_top", "log_top", "log_model"])
                at += n
            held.clear()
            docs.clear()

        for batch in slices(batches):
            held.append((batch.column("doc_key"), batch.column("doc_id")))
            docs += [np.frombuffer(x, np.int32) for x in batch.column("ids").to_pylist()]
            size += sum(map(len, docs[-batch.num_rows :])) if batch.num_rows else 0
            if size > SCORE_TOKENS:
                yield from flush()
                size = 0
        yield from flush()

    return run


def learn(docs: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """The trained weights; docs: training rows with doc_id and text, or such rows as dealt_rows stored them."""
    w = vocabulary.weights()
    if not vocabulary.total:
        return w
    dealt = (docs if "ids" in docs.columns else stored(dealt_rows(docs, vocabulary), "lm-train")).select("shard", "doc_id", "ids")

    for turn in range(ROUNDS):
        def one(table: pa.Table) -> pa.Table:
            rows = sorted(zip(table["doc_id"].to_pylist(), table["ids"].to_pylist()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
            ids = [np.frombuffer(x, np.int32) for _, x in rows]
            order = np.random.default_rng(turn).permutation(len(ids))
            got = train([ids[i] for i in order], vocabulary, {k: v.copy() for k, v in w.items()}, turn)
            return pa.table({"shard": table["shard"][:1], "tokens": pa.array([float(sum(map(len, ids)))]), "weights": pa.array([pack(got)], pa.binary())})

        def mean(table: pa.Table) -> pa.Table:
            tokens = table["tokens"].to_numpy()
            total = sum(n * np.frombuffer(x.as_py(), np.float32).astype(np.float64) for n, x in zip(tokens, table["weights"]))
            return pa.table({"shard": table["shard"][:1], "tokens": pa.array([float(tokens.sum())]), "weights": pa.array([(total / tokens.sum()).astype(np.float32).tobytes()], pa.binary())})

        schema = "shard long, tokens double, weights binary"
        rows = dealt.groupBy("shard").applyInArrow(one, schema)
        n = max(1, math.ceil(vocabulary.total / SHARD_TOKENS))
        while n > 1:
            n = -(-n // 32)
            rows = rows.withColumn("shard", F.pmod("shard", F.lit(n))).groupBy("shard").applyInArrow(mean, schema)
        found = rows.collect()
        if found:
            w = unpack(bytes(found[0]["weights"]), w)
    return w


def lm_scores(docs: DataFrame, top: int = TOP) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = rows.filter(~held_out(F.col("doc_id"), 7))
    counts = stored(training.select("text").mapInArrow(counted, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    best = [(bytes(r["token"]), r["n"]) for r in counts.filter(F.col("n") >= MIN_COUNT).orderBy(F.desc("n"), "token").limit(top).toArrow().to_pylist()]
    vocabulary = Vocabulary(best, total, distinct)
    coded = stored(dealt_rows(rows, vocabulary), "lm-coded")
    w = learn(coded.filter("not held_out"), vocabulary)

    scored = coded.select("doc_key", "doc_id", "ids").mapInArrow(score_rows(vocabulary, w), SCORED)
    rare = coded.select("doc_key", F.explode("rare").alias("r")).select("doc_key", "r.token", F.col("r.n").alias("times"))
    known = rare.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_doc = known.groupBy("doc_key").agg(F.sum("times").alias("n_rare"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_rare_known"), F.sum(F.col("times") * F.log(F.col("n") + 1)).alias("log_rare"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = scored.join(by_doc, "doc_key", "left")
    counted_log = F.col("log_top") + zero("log_rare")
    base = (counted_log - F.col("n_tokens") * math.log(total + distinct + 1)) / math.log(10)
    score = (F.col("log_model") + zero("log_rare") - zero("n_rare") * math.log(vocabulary.rest)) / math.log(10)
    return whole.select("doc_id", held_out(F.col("doc_id"), 7).alias("held_out"), "n_tokens", (F.col("n_top") + zero("n_rare_known")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
