"""Mixing to target weights with soft memberships.

A softmax classifier over hashed words and character patterns, fitted on all labelled rows, gives every document
posteriors over domains. The fit is L-BFGS: a step is a pass over the labelled rows' features, which sends a loss and a
gradient a task. Document rates r >= 0 are fitted so that the expected tokens of each domain,
sum of r * tokens * posterior, meet targets: the least sum of the squared deviations, each relative to what the
domain holds, plus RIDGE times the token-weighted squared distance of the rates from 1.

The fit is projected gradient descent, spread over the documents: a step takes from every rate its gradient, which needs
the domains' deviations only, times a step size, and sets what falls below 0 to 0. Step sizes are spectral (Barzilai and
Borwein's) with a non-monotone search. A rate follows from the steps made, a few numbers each, so nothing is kept for
the documents between steps, and a step sends a few sums a task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewright.llm.common import mix as mix_bits
from basewright.llm.common import slices, small_batches, table, text_or_empty, utf8, written

BUCKETS = 1 << 15
DOMAINS = ("clean", "toxic", "low", "low_toxic")
#: Target tokens of each domain, as shares of what the corpus is expected to hold. As posteriors are never 0, some clean
#: text goes with the rest, and some of each domain stays.
TARGETS = {"clean": 0.98, "toxic": 0.25, "low": 0.25, "low_toxic": 0.1}
RIDGE = 0.002
#: Weight of half the classifier's squared weights beside the mean loss of a row.
DECAY = 1e-4
#: The classifier's fit ends when a step promises less, in nats a row; some thirty to sixty steps do, so many at most.
LEAST_GAIN = 1e-4
FIT_STEPS = 500
#: Steps at most; sharp posteriors need some ten, domains that overlap a hundred.
STEPS = 400
#: The fit ends when no document's rate would be moved by more by a step of size 1.
TOLERANCE = 1e-6
#: Shares of a step's size that are tried in the same pass.
SHARES = (1.0, 0.25, 0.06, 0.01, 1e-3)
#: A step may not make the objective greater than the greatest of the last so many.
MEMORY = 10

#: Bytes of text that are hashed at a time; a word is not cut.
PIECE = 1 << 18
#: Texts whose buckets are sorted together, at most.
TOGETHER = 64

_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_MARK = np.isin(np.arange(256), list(b".,;:!?\"'()"))
_LOWER = mix_bits(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(1))
#: A bit for each kind of byte: small letters and all beyond ASCII, capitals, digits, and each other byte but white space.
_KIND = np.zeros(256, np.uint64)
_KIND[~_SPACE] = np.uint64(1) << np.unique([97 if c >= 128 or 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in np.flatnonzero(~_SPACE)], return_inverse=True)[1].astype(np.uint64)
_BASE = 0x9E3779B97F4A7C15


class Features:
    """Hash buckets of words, lower-cased and without outer marks, and of their kinds of characters."""

    def __init__(self):
        self._grow(PIECE)

    def _grow(self, n: int) -> None:
        """Powers of an odd base, and of its inverse, modulo 2^64."""
        factors = np.full((2, n + 1), [[_BASE], [pow(_BASE, -1, 2**64)]], np.uint64)
        factors[:, 0] = 1
        self.up, self.down = np.cumprod(factors, 1)

    def _hashed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of the word, bucket of its kinds) for words of ``data`` (bytes), differences of running sums."""
        if len(data) >= len(self.up):
            self._grow(2 * len(data))
        kinds = mix_bits(np.bitwise_or.reduceat(_KIND.take(data), starts)) % np.uint64(1023)  # white space has no bit
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_LOWER.take(data) * self.up[: len(data)], out=sums[1:])
        marks, starts, ends = _MARK.take(data), starts.copy(), ends.copy()
        left = np.flatnonzero(marks[starts])
        while left.size:
            starts[left] += 1
            left = left[starts[left] < ends[left]]
            left = left[marks[starts[left]]]
        left = np.flatnonzero((starts < ends) & marks[ends - 1])
        while left.size:
            ends[left] -= 1
            left = left[marks[ends[left] - 1]]  # the first byte is none
        words = mix_bits((sums[ends] - sums[starts]) * self.down[starts]) % np.uint64(BUCKETS - 1024)
        return words.astype(np.int64), kinds.astype(np.int64) + (BUCKETS - 1024)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(texts' numbers of words, of buckets, the buckets, their weights) of TOGETHER texts at most.

        A text's buckets ascend: words by presence, kinds by eight times their share of the words; the last is constant
        but for the share of repeated words.
        """
        data, n = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8), len(texts)
        turns = np.flatnonzero(np.diff(_SPACE.take(data)))  # a word's first byte is after a turn, its last byte at one
        starts, ends = turns[::2] + 1, turns[1::2] + 1
        owner = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), starts, "right")
        cuts = [*np.flatnonzero(np.diff(starts // PIECE, prepend=-1)), len(starts)]
        parts = [(np.empty(0, np.int64),) * 2]
        parts += [self._hashed(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i]) for i, j in zip(cuts, cuts[1:])]
        words, kinds = map(np.concatenate, zip(*parts, strict=True))
        n_words = np.bincount(owner, minlength=n)
        every = np.sort(np.concatenate([owner * BUCKETS + words, np.arange(n) * BUCKETS + BUCKETS - 1]).astype(np.int32))
        shares = np.bincount(owner * 1024 + kinds - (BUCKETS - 1024), minlength=n * 1024)
        some = np.flatnonzero(shares)
        at = np.sort(np.concatenate([every[np.flatnonzero(np.diff(every, prepend=-1))], (some >> 10) * BUCKETS + BUCKETS - 1024 + (some & 1023)]))
        of, at = at // BUCKETS, at % BUCKETS
        weights = np.ones(len(at))
        kind, last = np.flatnonzero((at >= BUCKETS - 1024) & (at < BUCKETS - 1)), np.flatnonzero(at == BUCKETS - 1)
        weights[kind] = 8 * shares[some] / n_words[of[kind]]
        n_found = np.bincount(of[at < BUCKETS - 1024], minlength=n)
        weights[last] = 1 + 4 * np.where(n_words > 0, 1 - n_found / np.maximum(n_words, 1), 0.0)
        return n_words, np.bincount(of, minlength=n), at, weights


def _together(texts: list[bytes]) -> Iterator[list[bytes]]:
    """``texts`` in runs of TOGETHER or some PIECE bytes at most, one at least."""
    group, size = [], 0
    for text in texts:
        if group and (len(group) == TOGETHER or size + len(text) > PIECE):
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def _binary(values: list[np.ndarray], sizes: list[np.ndarray]) -> pa.Array:
    """Rows of so many of the values each, as bytes."""
    flat, n = np.concatenate(values), np.concatenate([[0], *sizes])
    return pa.Array.from_buffers(pa.large_binary(), len(n) - 1, [None, pa.py_buffer(np.cumsum(n) * flat.itemsize), pa.py_buffer(flat)]).cast(pa.binary())


def text_features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Words of a text, its buckets (16 bits each), and the weights (32 bits each) of the last of them; others have 1."""
    features = Features()
    for column in texts:
        tokens, sizes, given, at, weight = [np.empty(0, np.int64)], [], [], [np.empty(0, np.uint16)], [np.empty(0, np.float32)]
        for group in _together(utf8(column)):
            n_words, n, buckets, weights = features.of(group)
            late = buckets >= BUCKETS - 1024
            tokens.append(n_words)
            sizes.append(n)
            given.append(np.bincount(np.repeat(np.arange(len(n)), n)[late], minlength=len(n)))
            at.append(buckets.astype(np.uint16))
            weight.append(weights[late].astype(np.float32))
        yield pa.StructArray.from_arrays([pa.array(np.concatenate(tokens)), _binary(at, sizes), _binary(weight, given)], ["tokens", "at", "weight"])


def _flat(at: pa.Array, weight: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, weights) of some texts in one, and where each begins; a text has one bucket at least."""
    each, last = at.to_pylist(), weight.to_pylist()
    sizes, given = np.array([len(x) >> 1 for x in each], np.int64), np.array([len(x) >> 2 for x in last], np.int64)
    value = np.ones(sizes.sum())
    value[np.repeat(np.cumsum(sizes) - np.cumsum(given), given) + np.arange(given.sum())] = np.frombuffer(b"".join(last), np.float32)
    return np.frombuffer(b"".join(each), np.uint16).astype(np.int64), value, np.cumsum(sizes) - sizes


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _told(labelled: DataFrame, n_domains: int) -> tuple[np.ndarray, np.ndarray, int]:
    """How much each bucket counts, its mean square over rows (by which steps are scaled), and the number of rows.

    Words count by how much their presence tells one domain from the others, and not at all where that is little.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_domains + 1, BUCKETS))
        for batch in slices(batches):
            at, value, starts = _flat(batch.column(1), batch.column(2))
            owner = np.repeat(batch.column(0).to_numpy(), np.diff(starts, append=len(at)))
            for d in range(n_domains):
                sums[d] += np.bincount(at[owner == d], minlength=BUCKETS)
            sums[-1] += np.bincount(at, value**2, BUCKETS)
        some = np.flatnonzero(sums[-1])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(x[some]) for x in sums)], names)

    names = ["at", *(f"s{d}" for d in range(n_domains + 1))]
    found = labelled.mapInArrow(run, "at int, " + ", ".join(f"{x} double" for x in names[1:])).groupBy("at").agg(*(F.sum(x).alias(x) for x in names[1:])).toArrow()
    sums = np.zeros((n_domains + 1, BUCKETS))
    sums[:, found["at"].to_numpy()] = [found[x].to_numpy() for x in names[1:]]
    seen, n = sums[:-1].T, sums[:-1, BUCKETS - 1]  # the constant is in every row
    ratio = np.log((seen + 3) / (n + 6)) - np.log((seen.sum(1, keepdims=True) - seen + 3) / (n.sum() - n + 6))
    told = np.where(n >= 10, np.abs(ratio), 0).max(1)
    told[told < 0.7] = 0
    told[BUCKETS - 1024 :] = 1
    return told, told**2 * sums[-1] / max(1, n.sum()), int(n.sum())


def _loss(rows: DataFrame, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """The summed loss of ``rows(domain, at, value)`` and its gradient. A row of sums a task and bucket."""
    sent, (size, n) = rows.sparkSession.sparkContext.broadcast(weights), weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, total = np.ascontiguousarray(sent.value.T), np.zeros((n, size + 1))
        for batch in slices(batches):
            domain, each = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            at = np.frombuffer(b"".join(each), np.uint16).astype(np.int64)
            value = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).astype(np.float64)
            sizes = np.array([len(x) >> 1 for x in each])
            starts, nth = np.cumsum(sizes) - sizes, np.arange(len(sizes))
            p = _softmax(np.stack([np.add.reduceat(value * w[d].take(at), starts) for d in range(n)], 1))
            total[0, size] -= np.log(np.maximum(p[nth, domain], 1e-300)).sum()
            p[nth, domain] -= 1
            for d in range(n):
                total[d, :size] += np.bincount(at, value * np.repeat(p[:, d], sizes), size)
        yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), *(pa.array(x) for x in total)], names)

    names = ["at", *(f"s{d}" for d in range(n))]
    found = rows.mapInArrow(run, "at int, " + ", ".join(f"{x} double" for x in names[1:])).groupBy("at").agg(*(F.sum(x).alias(x) for x in names[1:])).toArrow()
    out = np.zeros((size + 1, n))
    out[found["at"].to_numpy()] = np.stack([found[x].to_numpy() for x in names[1:]], 1)
    sent.unpersist()
    return float(out[size, 0]), out[:size]


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], scale: np.ndarray, least_gain: float = LEAST_GAIN, steps: int = FIT_STEPS) -> np.ndarray:
    """Where ``f``, which gives a convex function's value and gradient, is least, by L-BFGS from 0. ``scale``: roughly
    the inverse second derivatives. A fit that does not come to ``least_gain`` is an error."""
    x, past = np.zeros(scale.shape), deque(maxlen=MEMORY)
    value, gradient = f(x)
    for _ in range(steps):
        move, back = -gradient, []
        for s, y in reversed(past):
            back.append((s * move).sum() / (s * y).sum())
            move = move - back[-1] * y
        move = move * scale * ((past[-1][0] * past[-1][1]).sum() / (past[-1][1] ** 2 * scale).sum() if past else 1.0)
        for (s, y), a in zip(past, reversed(back), strict=True):
            move = move + (a - (y * move).sum() / (s * y).sum()) * s
        slope = (gradient * move).sum()
        if -slope / 2 < least_gain and (gradient**2 * scale).sum() / 2 < 100 * least_gain:
            return x
        size = 1.0
        while (new := f(x + size * move))[0] > value + 1e-4 * size * slope and size > 1e-6:
            size /= 4
        if ((new[1] - gradient) * move).sum() > 0:
            past.append((size * move, new[1] - gradient))
        x, (value, gradient) = x + size * move, new
    raise ArithmeticError(f"classifier not fitted within {steps} steps: one promises {-slope / 2} nats a row")


def fit_classifier(labelled: DataFrame, n_domains: int, decay: float = DECAY) -> np.ndarray:
    """Weights [BUCKETS, n_domains] of a softmax regression on all rows of ``labelled(domain, at, weight)``: the mean
    loss of a row and ``decay`` times half the squared weights of what counts are least. Without rows all are 0."""
    told, squares, n_rows = _told(labelled, n_domains)
    if not n_rows:
        return np.zeros((BUCKETS, n_domains))
    some = np.flatnonzero((told > 0) & (squares > 0))
    nth = np.full(BUCKETS, -1)
    nth[some] = np.arange(len(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, value, starts = _flat(batch.column(1), batch.column(2))
            kept, value = nth[at] >= 0, value * told[at]
            sizes = np.add.reduceat(kept, starts, dtype=np.int64)
            cells, ends = (nth[at[kept]].astype(np.uint16), value[kept].astype(np.float32)), np.cumsum(sizes)
            parts = ([x[e - k : e].tobytes() for e, k in zip(ends, sizes, strict=True)] for x in cells)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.binary()) for x in parts)], ["domain", "at", "value"])

    rows = written(labelled.mapInArrow(run, "domain int, at binary, value binary"))

    def mean_loss(weights: np.ndarray) -> tuple[float, np.ndarray]:
        loss, gradient = _loss(rows, weights)
        return loss / n_rows + decay / 2 * (weights**2).sum(), gradient / n_rows + decay * weights

    weights = np.zeros((BUCKETS, n_domains))
    weights[some] = minimise(mean_loss, np.repeat(1 / (squares[some, None] / n_domains + decay), n_domains, 1))
    return weights * told[:, None]


def posterior_of(weights: np.ndarray, spark: SparkSession) -> Column:
    """The posterior (array of doubles) by _features."""
    sent = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("array<double>")
    def posterior(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        w = sent.value
        for at, weight in parts:
            found = [np.empty((0, w.shape[1]))]
            for i in range(0, len(at), 256):
                flat, value, starts = _flat(at.slice(i, 256), weight.slice(i, 256))
                found.append(_softmax(np.add.reduceat(value[:, None] * w[flat], starts)))
            p = np.concatenate(found)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * w.shape[1], pa.int32()), pa.array(p.ravel()))

    return posterior.asNondeterministic()("_features.at", "_features.weight")  # so that a filter by it makes it once only


Steps = list[tuple[float, np.ndarray]]


def rate_after(past: Steps, ridge: float, max_rate: float | None) -> Column:
    """The rate after the steps whose sizes and domain deviations are given, from a rate of 1, as a function of
    _posterior."""
    if not past:
        return F.lit(1.0)

    def move(r: Column, x: Column) -> Column:
        dot = sum((F.col("_posterior")[i] * x[i + 1] for i in range(1, len(past[0][1]))), F.col("_posterior")[0] * x[1])
        r = F.greatest(F.lit(0.0), r - x[0] * (dot + ridge * (r - 1)))
        return r if max_rate is None else F.least(F.lit(float(max_rate)), r)

    return F.aggregate(F.lit([[size, *d.tolist()] for size, d in past]), F.lit(1.0), move)


def _tried(members: DataFrame, past: Steps, deviations: np.ndarray, sizes: list[float], ridge: float, max_rate: float | None) -> tuple[list[tuple[np.ndarray, float, float]], float]:
    """For a step of each size after ``past``: expected domain tokens, and the token-weighted squares of what rates move
    by and of their distance from 1; and the most that a step of size 1 would move a rate. A row of sums a task and size."""
    most, n = np.inf if max_rate is None else max_rate, len(deviations)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, far = np.zeros((len(sizes), n + 2)), 0.0
        for batch in batches:
            tokens, p = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, n)
            r = np.ones(len(tokens))
            for size, d in past:
                r = np.clip(r - size * (p @ d + ridge * (r - 1)), 0, most)
            gradient = p @ deviations + ridge * (r - 1)
            far = max(far, np.abs(np.clip(r - gradient, 0, most) - r).max(initial=0))
            for out, size in zip(total, sizes, strict=True):
                new = np.clip(r - size * gradient, 0, most)
                out[:n] += (new * tokens) @ p
                out[n] += tokens @ (new - r) ** 2
                out[n + 1] += tokens @ (new - 1) ** 2
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size + 1), pa.int32()), pa.array([*total.ravel(), far])], ["d", "s"])

    out, far = np.zeros((len(sizes), n + 2)), 0.0
    for d, total, most_ in members.select("_tokens", "_posterior").mapInArrow(run, "d int, s double").groupBy("d").agg(F.sum("s"), F.max("s")).collect():
        if d < out.size:
            out.ravel()[d] = total
        else:
            far = most_
    return [(x[:n], x[n], x[n + 1]) for x in out], far


def expected_tokens(members: DataFrame, n: int) -> np.ndarray:
    """Tokens by domain at rates of 1."""
    return _tried(members, [], np.zeros(n), [0.0], 0.0, None)[0][0][0]


def fit_rates(members: DataFrame, present: np.ndarray, targets: np.ndarray, ridge: float = RIDGE, max_rate: float | None = None, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[Steps, np.ndarray]:
    """(steps that make the rates, expected domain tokens reached) for ``members(_tokens, _posterior)``.

    Minimises sum_d (S_d - T_d)^2 / (2 P_d) + ridge / 2 * sum_i n_i (r_i - 1)^2 over rates of 0 and more (max_rate at
    most, if given), with S_d the expected tokens of domain d, and P_d those at rates of 1 (``present``); ridge > 0. A
    fit that does not come within the tolerance is an error.
    """
    scale = np.maximum(present, 1e-9)
    value = lambda s, q: float(((s - targets) ** 2 / (2 * scale)).sum() + ridge / 2 * q)
    past: Steps = []
    reached, values, size = present, [value(present, 0.0)], 1.0
    for _ in range(steps):
        deviations = (reached - targets) / scale
        sizes = [size * share for share in SHARES]
        tried, far = _tried(members, past, deviations, sizes, ridge, max_rate)
        if far < tolerance:
            return past, reached
        limit = max(values[-MEMORY:]) + 1e-12 * abs(values[0])
        good = [i for i, (s, moved, q) in enumerate(tried) if value(s, q) <= limit - 1e-4 / sizes[i] * moved]
        at = good[0] if good else len(sizes) - 1
        new, moved, q = tried[at]
        bend = float(((new - reached) ** 2 / scale).sum() + ridge * moved)
        past.append((sizes[at], deviations))
        size = min(max(moved / bend, 1e-3), 1 / ridge) if bend > 0 else 1.0
        reached = new
        values.append(value(new, q))
    raise ArithmeticError(f"rates not fitted within {steps} steps: a step of size 1 would move one by {far}")


def label_domains(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(domain, at, weight) of all ``rows(doc_id, _features)`` with labels: 0 clean, 1 toxic, 2 low quality, 3 both."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    domains = one.agg((F.min("quality") == 0).cast("int").alias("low"), F.max("toxic").alias("toxic")).select("doc_id", (F.col("low") * 2 + F.col("toxic")).cast("int").alias("domain"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "_features").join(domains, "doc_id").select("domain", "_features.at", "_features.weight")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float | None = None, ridge: float = RIDGE, steps: int = STEPS, keep_text: bool = True) -> DataFrame:
    """``docs(doc_id, text, ...)`` (its text only if ``keep_text``) with n_tokens (words), posterior, rate, expected_share and target_share.

    targets: for each domain, its tokens wanted as a share of those expected at a rate of 1. max_rate: a bound of the
    rates, as 1 for corpora that may not repeat documents; none but 0 below if null. Null text has no tokens and the classifier's constant
    posterior. Without labels all domains are equally likely. Namesakes among the other columns are replaced,
    and _tokens, _posterior and _features dropped; repeated rows have their own rates, equal ones; an empty table stays empty.
    """
    docs = docs.drop("n_tokens", "posterior", "rate", "expected_share", "target_share", "_tokens", "_posterior", "_features")
    rows = docs.withColumn("_features", F.arrow_udf(text_features, "tokens long, at binary, weight binary")("text"))
    with small_batches(docs.sparkSession):
        rows = written(rows if keep_text else rows.drop("text"))
        weights = fit_classifier(written(label_domains(rows, labels)), len(DOMAINS))
    whole = rows.withColumns({"_tokens": F.col("_features.tokens"), "_posterior": posterior_of(weights, docs.sparkSession)})
    members = written(whole.select("_tokens", "_posterior"))
    present = expected_tokens(members, len(DOMAINS))
    wanted = present * np.array([targets[d] for d in DOMAINS])
    past, reached = fit_rates(members, present, wanted, ridge, max_rate, steps)
    total = max(present.sum(), 1.0)
    return whole.select(
        *(c for c in docs.columns if keep_text or c != "text"), F.col("_tokens").alias("n_tokens"), F.col("_posterior").alias("posterior"), rate_after(past, ridge, max_rate).alias("rate"),
        F.lit((reached / total).tolist()).alias("expected_share"), F.lit((wanted / total).tolist()).alias("target_share"),
    )


def apply_rates(mixed: DataFrame) -> DataFrame:
    """Each row as often as its rate says: its whole part, and once more with the rest as probability, by a hash of
    the id and text, so that the same rows stay on every run."""
    u = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_or_empty(), F.lit(20_240_503)), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    rows = mixed.withColumn("_times", times.cast("int")).where("_times > 0")
    return rows.withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_each")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mix(docs, table(spark, sf_dir, "labels"), keep_text=False)
