"""Scalar functions from Column to Column, and small frame functions around them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def version_key(col) -> Column:
    """The first two components of a version as struct(major, minor); null where they are no numbers."""
    part = lambda k: F.regexp_extract(_c(col), r"^(\d+)\.(\d+)", k).try_cast("int")
    return F.when(_c(col).rlike(r"^\d+\.\d+"), F.struct(part(1).alias("major"), part(2).alias("minor")))


def version_text(col) -> Column:
    """Major and zero-padded minor, so that text order is version order."""
    k = version_key(col)
    return F.concat_ws(".", F.lpad(k["major"].cast("string"), 3, "0"), F.lpad(k["minor"].cast("string"), 3, "0"))


def id_from_path(col) -> Column:
    """File name without its extension, dots as underscores."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(_c(col), "/"), -1), r"\.[^.]*$", ""), r"\.", "_")


def group_of(col, last: bool = True) -> Column:
    return F.substring_index(_c(col), "_", -1 if last else 1)


def week_index(col, origin) -> Column:
    return F.floor(F.datediff(_c(col), origin) / 7).cast("int")


def remap(col, mapping: dict, default=None) -> Column:
    """A fixed mapping as a chain of conditions; default for the rest (None: unchanged)."""
    chain = reduce(lambda c, kv: c.when(_c(col) == F.lit(kv[0]), F.lit(kv[1])), mapping.items(), F)
    return chain.otherwise(_c(col) if default is None else F.lit(default))


def bin_by(col, edges: list, labels: list) -> Column:
    """labels[i] where edges[i-1] <= x < edges[i]; one label more than edges."""
    assert len(labels) == len(edges) + 1
    chain = F.when(_c(col).isNull(), F.lit(None))
    for e, label in zip(edges, labels):
        chain = chain.when(_c(col) < F.lit(e), F.lit(label))
    return chain.otherwise(F.lit(labels[-1]))


def decile(col) -> Column:
    return F.least(F.greatest(F.floor(_c(col) * 10), F.lit(0)), F.lit(9)).cast("int")


def surprisal(col, eps: float = 1e-3) -> Column:
    return -F.log10(_c(col) + F.lit(eps))


def logit(col, eps: float = 1e-6) -> Column:
    p = F.least(F.greatest(_c(col), F.lit(eps)), F.lit(1 - eps))
    return F.log(p / (1 - p))


def sigmoid(col) -> Column:
    return 1 / (1 + F.exp(-_c(col)))


def matches(col, pattern: str) -> Column:
    """Case-insensitive match; false for null."""
    return F.coalesce(_c(col).rlike(f"(?i){pattern}"), F.lit(False))


def fit_length(col, n: int, fill) -> Column:
    return F.slice(F.concat(_c(col), F.array_repeat(F.lit(fill), n)), 1, n)


def _let(value, body) -> Column:
    """body of a value that is computed once per row, not once per use."""
    return F.transform(F.array(value), body)[0]


def zscore_array(col, eps: float = 1e-8) -> Column:
    """(x - mean) / (population deviation + eps) inside each array."""
    v = _c(col)
    total = lambda f: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x)) / F.size(v)
    scaled = lambda m, sd: F.transform(v, lambda x: (x - m) / (sd + F.lit(eps)))
    return _let(total(lambda x: x), lambda m: _let(F.sqrt(total(lambda x: (x - m) * (x - m))), lambda sd: scaled(m, sd)))


def even_starts(col, k: int) -> Column:
    """k evenly spaced whole starts from 0 to the value."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * _c(col) / (k - 1)).cast("int"))


def hash_uniform(seed, *keys) -> Column:
    """A uniform number in [0, 1) from a seed and keys: the first 32 bits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_c(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def uniform_sql(seed, *keys: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(('0x' || substr(md5({text}), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


#: A prime under 2^31; x -> x^5 permutes the numbers below it.
PRIME = 2147483647
#: Cumulative chances of a Poisson number with mean 1: it is k or less with chance POISSON[k].
POISSON = tuple(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12))


def seed_pair(seed, key) -> tuple[Column, Column]:
    """Two numbers below PRIME from an MD5 of a seed and a key."""
    text = F.md5(F.concat_ws("|", F.lit(str(seed)), _c(key).cast("string")))
    return tuple(F.conv(F.substring(text, at, 8), 16, 10).cast("long") % PRIME for at in (1, 9))


#: Weights that are worked out at once: some arrays of so many numbers stay in a core's cache.
WEIGHTS = 32_000


def poisson_weights(a, b, reps: int):
    """How often draws 0 to reps - 1 take what the pairs (a, b) stand for: Poisson numbers of mean 1, by integer arithmetic alone; (pairs, reps), bytes.

    A draw's number is ((a + draw * 1000003)^5 + b)^5 modulo PRIME, which is 2^31 - 1: what lies above the 31st bit is added to what
    lies below, and only the last number must be the remainder itself.
    """
    import numpy as np

    prime, bits = np.uint64(PRIME), np.uint64(31)
    cuts = [int(c * PRIME) for c in POISSON]

    def fold(x, other):  # below 2^62: to 2^32 - 2 at most; below 2^64: to less than 5 * 2^31
        np.right_shift(x, bits, out=other)
        np.bitwise_and(x, prime, out=x)
        np.add(x, other, out=x)

    def less(x, other):  # one prime less where there is one; without one the difference wraps round to a large number
        np.subtract(x, prime, out=other)
        np.minimum(x, other, out=x)

    def fifth(x, square, other):  # x a little above 2^31 at most
        np.multiply(x, x, out=square)
        fold(square, other)
        less(square, other)
        np.multiply(square, square, out=square)
        fold(square, other)
        np.multiply(x, square, out=x)
        fold(x, other)

    steps = np.arange(reps, dtype=np.uint64) * np.uint64(1000003) % prime
    a, b = (np.asarray(v).astype(np.uint64)[:, None] for v in (a, b))
    weights = np.zeros((len(a), reps), np.uint8)
    rows = max(1, WEIGHTS // max(1, reps))
    whole = [np.empty((rows, reps), t) for t in (np.uint64, np.uint64, np.uint64, np.int32, bool)]
    for lo in range(0, len(a), rows):
        own = weights[lo : lo + rows]
        x, square, other, draw, hit = (w[: len(own)] for w in whole)
        np.add(a[lo : lo + rows], steps, out=x)
        less(x, other)
        fifth(x, square, other)
        np.add(x, b[lo : lo + rows], out=x)
        fold(x, other)
        fifth(x, square, other)
        fold(x, other)
        less(x, other)
        draw[...] = x
        for c in cuts:
            np.greater_equal(draw, c, out=hit)
            if not hit.any():
                break
            np.add(own, hit.view(np.uint8), out=own)
    return weights


def poisson_sql(a: str, b: str, rep: str) -> tuple[str, str, str]:
    """poisson_weights in three steps: y, x from y, and the weight from x."""
    fifth = lambda x: f"(({x} * {x} % {PRIME}) * ({x} * {x} % {PRIME}) % {PRIME} * {x} % {PRIME})"
    first = f"(({a} + CAST({rep} AS BIGINT) * 1000003) % {PRIME})"
    return fifth(first), fifth(f"((y + {b}) % {PRIME})"), " + ".join(f"(x >= {int(c * PRIME)})::INT" for c in POISSON)


def numbered(df: DataFrame, col: str, name: str) -> DataFrame:
    """df with numbers from 0 in the order of a column, over all rows (no two rows may share a value).

    Rows are sorted over tasks and stored with their task; counts by task say where each task's numbers start, and rows are numbered
    within their task, so no task sees all of them.
    """
    from tallyard.sources.readers import stored

    rows = stored(df.repartitionByRange(col).withColumn("_task", F.spark_partition_id()), "numbered")
    tasks = rows.groupBy("_task").agg(F.count("*").alias("_c")).withColumn("_before", F.sum("_c").over(Window.orderBy("_task")) - F.col("_c"))
    inside = F.row_number().over(Window.partitionBy("_task").orderBy(col)) - 1
    return rows.join(tasks.drop("_c"), "_task").withColumn(name, inside + F.col("_before")).drop("_task", "_before")


def index_categories(df: DataFrame, col: str) -> DataFrame:
    """(col, index): dense numbers from 0 in sorted order of the distinct values; nulls have none."""
    return numbered(df.select(col).filter(F.col(col).isNotNull()).distinct(), col, "index")


def zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds <col>_z for each column, by the sample deviation; the statistics are one row."""
    stats = df.agg(*[f(F.col(c)).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = df.crossJoin(F.broadcast(stats))
    for c in cols:
        out = out.withColumn(f"{c}_z", F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")))
    return out.drop(*[f"_{n}_{c}" for c in cols for n in "ms"])


def days_since_first(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Adds age_days: days since the first date of the keys; first dates are aggregated, then joined."""
    first = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(date).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return df.join(first, same).withColumn("age_days", F.datediff(date, "_first")).drop("_first", *[f"_k{i}" for i in range(len(keys))])


def signed_features(df: DataFrame, contest: str, item: str, side: str, own) -> DataFrame:
    """(contest, item, sign): own side counts +1, the other -1."""
    return df.groupBy(contest, item).agg(F.sum(F.when(F.col(side) == own, 1).otherwise(-1)).cast("long").alias("sign"))


def context_features(df: DataFrame, contest: str, side: str, role: str, item: str, slot: str) -> DataFrame:
    """(contest, slot, token): for each row, who else is in its contest, where and on which side."""
    a = df.select(F.col(contest).alias("contest"), F.col(slot).alias("slot"), F.col(side).alias("own"))
    b = df.select(F.col(contest).alias("other_contest"), F.col(slot).alias("other_slot"), F.col(side).alias("other_side"), F.col(role).alias("other_role"), F.col(item).alias("other_item"))
    both = a.join(b, (F.col("contest") == F.col("other_contest")) & (F.col("slot") != F.col("other_slot")))
    ally = F.when(F.col("own") == F.col("other_side"), "ally").otherwise("enemy")
    return both.select("contest", "slot", F.concat_ws(":", "other_item", "other_role", ally).alias("token"))


def segment(df: DataFrame, series: str, frame: str, length: int) -> DataFrame:
    """Adds segment = frame // length; a short tail goes unless it is the only segment."""
    w = Window.partitionBy(series)
    n = F.max(frame).over(w) + 1
    cut = df.withColumn("segment", F.floor(F.col(frame) / length)).withColumn("_n", n)
    return cut.filter((F.col("segment") < F.floor(F.col("_n") / length)) | (F.col("_n") < length)).drop("_n")


def segment_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def random_crops(df: DataFrame, key: str, col: str, k: int, n: int, seed) -> DataFrame:
    """k crops of length n of each array, at hashed starts."""
    rows = df.withColumn("crop", F.explode(F.sequence(F.lit(1), F.lit(k))))
    start = F.floor(hash_uniform(seed, key, "crop") * F.greatest(F.size(col) - n + 1, F.lit(1))).cast("int")
    return rows.withColumn("start", start).withColumn("window", F.slice(F.col(col), F.col("start") + 1, n))


def mask_spans(df: DataFrame, key: str, col: str, width: int, probability: float, seed) -> DataFrame:
    """Zeroes one span of width values, at a hashed start, in the arrays that a hash picks."""
    start = F.floor(hash_uniform(seed, key, F.lit("at")) * F.greatest(F.size(col) - width + 1, F.lit(1))).cast("int")
    rows = df.withColumn("masked", hash_uniform(seed, key, F.lit("on")) < probability).withColumn("start", start)
    return rows.withColumn(col, F.when(F.col("masked"), F.transform(F.col(col), lambda x, i: F.when((i >= F.col("start")) & (i < F.col("start") + width), 0.0).otherwise(x))).otherwise(F.col(col)))


def trim_quiet(df: DataFrame, series: str, frame: str, level: str, top_db: float, least: int) -> DataFrame:
    """Frames between the first and last that come within top_db of the series' loudest; all if too few remain."""
    w = Window.partitionBy(series)
    loud = F.col(level) > F.max(level).over(w) - top_db
    rows = df.withColumn("_loud", loud)
    first, last = (f(F.when(F.col("_loud"), F.col(frame))).over(w) for f in (F.min, F.max))
    rows = rows.withColumn("_a", first).withColumn("_b", last)
    return rows.filter((F.col("_b") - F.col("_a") + 1 < least) | F.col(frame).between(F.col("_a"), F.col("_b"))).drop("_loud", "_a", "_b")


def with_default(required: DataFrame, predictions: DataFrame, key: str, col: str, default, fail_on_missing: bool = False) -> DataFrame:
    """Every required key with its prediction, or the default (or an error)."""
    joined = required.select(key).join(predictions.select(key, col), key, "left")
    rest = F.raise_error(F.concat(F.lit("no prediction for "), F.col(key).cast("string"))) if fail_on_missing else F.lit(default)
    return joined.withColumn(col, F.coalesce(F.col(col), rest))
