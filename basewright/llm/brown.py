"""LM scoring with Brown class-based n-grams.

Every word seen MIN_COUNT times in training is a type of its own; rarer and unknown words share the type of their last
three characters, in ENDINGS groups; the end of a text is a type and a class of its own. Exchange clustering moves types
between classes as long as the likelihood of the class bigrams grows, in two steps: first the head, words with HEAD_SHARE
of the tokens, and the endings, which also stand for all words between; then these words, from their ending's class on,
beside the whole text around them. A text's probability is the product of class transitions (class trigrams, mixed
with bigrams and unigrams by deleted interpolation) and of emissions: the type's share of its class, and, for rare
words, the word's share of its type, in which the share of words seen once stands for unknown words.

Texts are split twice, to count words and to write them as numbers of types; all else reads the numbers. The words
broadcast for this are MOST_SENT at most (the head, 1 / HEAD_SHARE words, among them); all others of a text are joined
with the vocabulary. Counts of the exchange are grouped by word into parts of bounded size and stay where they are
between rounds. The class map is a byte a type. It has all words with MIN_COUNT occurrences, up to MOST_CORE (64 MB),
which no test table comes near: beyond it the least count is raised, in steps of a twelfth.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewright.llm.common import slices, table, text_or_empty, utf8, written

CLASSES = 64
MIN_COUNT = 20
HEAD_SHARE = 1 / 8192
ENDINGS = 1024
MOST_SENT = 400_000
MOST_CORE = 1 << 26
#: A step of the exchange ends when two rounds gain less than this, in nats a token; the limit is not met in practice.
TOLERANCE = 1e-3
MOST_ROUNDS = 100
#: Training tokens for each part of the neighbours of words below the head.
PART_TOKENS = 2_000_000
#: No word holds white space, so this stands for the end of a text.
END = b" "


def words(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased: bytes.lower() and bytes.split() know only ASCII, as is wanted."""
    return text.lower().split()


class Endings(dict):
    """Groups of words by their last three characters."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 100_000:
            self.clear()
        value = self[word] = zlib.crc32(word.decode("utf-8", "replace")[-3:].encode()) % ENDINGS
        return value


class Places(dict):
    """Places of the words sent, -1 of others."""

    def __missing__(self, word: bytes) -> int:
        return -1


def _rows(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def count_words(texts: DataFrame, most: int = 500_000) -> DataFrame:
    """(word, c) over ``texts(text)``; END counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return batch

        for batch in slices(batches):
            counts[END] += batch.num_rows
            for text in utf8(batch.column(0)):
                counts.update(words(text))
                if len(counts) > most:
                    yield out()
        yield out()

    return texts.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.concatenate(codes)
    order = np.argsort(flat, kind="stable")
    flat, weight = flat[order], np.concatenate(counts)[order]
    if not len(flat):
        return flat, weight
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    return flat[first], np.add.reduceat(weight, first)


def _flat(codes: pa.Array, before: int, after: int, end: int) -> np.ndarray:
    """Types of texts in a row, each with ``before`` ends before it and ``after`` after it."""
    e = np.int32(end).tobytes()
    return np.frombuffer(e * before + (e * (after + before)).join(codes.to_pylist()) + e * after, np.int32)


def _count_codes(coded: DataFrame, make: Callable[[pa.Array], np.ndarray], width: int, names: list[str]) -> DataFrame:
    """Counts of integer codes that ``make(codes)`` gives for a slice of ``coded``, split into base-``width`` digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            codes, counts = _summed(*map(list, zip(*held, strict=True)))
            digits = [(codes // width**i % width).astype(np.int32) for i in range(len(names) - 2, -1, -1)]
            return _rows(names, [*digits, counts])

        for batch in slices(batches):
            codes, counts = np.unique(make(batch.column(0)), return_counts=True)
            held.append((codes, counts))
            size += len(codes)
            if size > 3_000_000:
                held[:] = [_summed(*map(list, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > 2_000_000:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    *digits, n = names
    counted = coded.select("codes").mapInArrow(run, ", ".join([*(f"{d} int" for d in digits), f"{n} long"]))
    return counted.groupBy(*digits).agg(F.sum(n).alias(n))


def count_bigrams(coded: DataFrame, coarse: np.ndarray) -> DataFrame:
    """(prev, cur, n) over adjacent coarse types, with the end of a text before its first word and after its last."""
    width = int(coarse[-1]) + 1
    sent = coded.sparkSession.sparkContext.broadcast(coarse)

    def make(codes: pa.Array) -> np.ndarray:
        flat = sent.value[_flat(codes, 0, 1, len(sent.value) - 1)].astype(np.int64)
        return np.concatenate([[width - 1], flat[:-1]]) * width + flat if len(flat) else flat

    return _count_codes(coded, make, width, ["prev", "cur", "n"])


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(between: np.ndarray) -> float:
    """The log-likelihood of class bigrams, but for what no exchange changes."""
    between = between.astype(float)
    return float(_xlogx(between).sum() - _xlogx(between.sum(0)).sum() - _xlogx(between.sum(1)).sum())


def best_classes(own: int, left: np.ndarray, right: np.ndarray, itself: float, between: np.ndarray) -> tuple[int, float]:
    """The class that a type of class ``own`` best moves to, and what the log-likelihood gains by it.

    left, right: its counts after and before each class, without those beside itself; itself: these; between: counts
    of class after class, all included. The last class is the end's, which no type joins.
    """
    x = between.astype(float)
    x[:, own] -= left
    x[own, :] -= right
    x[own, own] -= itself
    here = np.diag(x)
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    into = (_xlogx(x[a] + left[a, None]) - _xlogx(x[a])).sum(0) - (_xlogx(here + left) - _xlogx(here))
    into += (_xlogx(x[:, b] + right[None, b]) - _xlogx(x[:, b])).sum(1) - (_xlogx(here + right) - _xlogx(here))
    into += _xlogx(here + left + right + itself) - _xlogx(here)
    as_prev, as_cur = x.sum(1) + left, x.sum(0) + right
    into -= _xlogx(as_prev + right.sum() + itself) - _xlogx(as_prev) + _xlogx(as_cur + left.sum() + itself) - _xlogx(as_cur)
    best = int(np.argmax(into[:-1]))
    return best, float(into[best] - into[own])


class Rounds:
    """When an exchange ends: two rounds, which move each type once, gained too little. Keeps the best state."""

    def __init__(self, tolerance: float):
        self.tolerance, self.values, self.best = tolerance, [], None

    def ended(self, between: np.ndarray, now: np.ndarray) -> bool:
        value = likelihood(between)
        if self.best is None or value > max(self.values):
            self.best = now
        self.values.append(value)
        return len(self.values) > 2 and value - self.values[-3] < self.tolerance * max(1, int(between.sum()))


def exchange(bigrams: DataFrame, counts: np.ndarray, classes: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """Classes of all types, 0 .. classes - 1, and ``classes`` for the end.

    Each round counts every type with the classes beside it and moves half of the types, alternately. The state
    with the greatest likelihood is returned.
    """
    spark, n = bigrams.sparkSession, len(counts)
    rank = np.argsort(np.argsort(-counts[:-1], kind="stable"))
    now = np.append(rank % classes, classes)
    width, rounds = classes + 1, Rounds(tolerance)
    for round_ in range(MOST_ROUNDS):
        sent = spark.sparkContext.broadcast(now)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, sides = sent.value, np.zeros((3, n * width), np.int64)  # before a type, after it, and beside itself
            for batch in batches:
                prev, cur, c = (batch.column(i).to_numpy() for i in range(3))
                same = prev == cur
                np.add.at(sides[2], cur[same] * np.int64(width), c[same])
                prev, cur, c = prev[~same], cur[~same], c[~same]
                np.add.at(sides[0], cur * np.int64(width) + own[prev], c)
                np.add.at(sides[1], prev * np.int64(width) + own[cur], c)
            side, at = np.nonzero(sides)
            yield _rows(["side", "type", "class", "n"], [side.astype(np.int32), (at // width).astype(np.int32), (at % width).astype(np.int32), sides[side, at]])

        beside = bigrams.mapInArrow(near, "side int, type int, class int, n long").groupBy("side", "type", "class").agg(F.sum("n").alias("n")).persist()
        between = np.zeros((width, width), np.int64)
        own_class = F.element_at(F.lit(now.tolist()), F.col("type") + 1)
        for a, b, c in beside.where("side = 0").groupBy("class", own_class.alias("own")).agg(F.sum("n")).collect():
            between[a, b] = c
        for a, c in beside.where("side = 2").groupBy(own_class.alias("own")).agg(F.sum("n")).collect():
            between[a, a] += c
        if rounds.ended(between, now):
            beside.unpersist()
            break
        matrix = spark.sparkContext.broadcast(between)

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for kind, near_by in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    sides = np.zeros((3, width))
                    for x in near_by:
                        sides[x["side"], x["class"]] = x["n"]
                    to, gain = best_classes(sent.value[kind], sides[0], sides[1], sides[2, 0], matrix.value)
                    out.append((kind, to, gain))
                yield _rows(["type", "to", "gain"], [np.array(x, k) for x, k in zip(zip(*out, strict=True), (np.int32, np.int32, float), strict=True)] if out else [np.empty(0, k) for k in (np.int32, np.int32, float)])

        some = beside.where((F.col("type") != n - 1) & (F.pmod(F.xxhash64("type"), F.lit(2)) == round_ % 2))
        lists = some.groupBy("type").agg(F.collect_list(F.struct("side", "class", "n")).alias("near"))  # 2 * width + 1 entries at most
        now = now.copy()
        for kind, to, gain in lists.mapInArrow(move, "type int, to int, gain double").where("gain > 1e-6").collect():
            now[kind] = to
        beside.unpersist()
    return rounds.best


class Middle:
    """Numbers of the words between the head and the endings: part and place within it."""

    def __init__(self, first: int, n: int, tokens: int):
        self.first, self.n = first, n
        self.parts = max(1, -(-n // 20_000), -(-tokens // PART_TOKENS))
        self.size = -(-n // self.parts)

    def types(self, part: int) -> np.ndarray:
        return self.first + np.arange(part, self.n, self.parts)


_NEAR = pa.schema([("part", pa.int32()), ("slot", pa.binary()), ("slot_n", pa.binary()), ("at_n", pa.binary()), ("other", pa.binary()), ("other_n", pa.binary())])
_NEAR_SQL = "part int, slot binary, slot_n binary, at_n binary, other binary, other_n binary"


def _near_row(part: int, slots: tuple, others: tuple) -> pa.RecordBatch:
    """Slots and their counts; and neighbours by ``at``, their numbers and the neighbours with their counts, of 65,535
    at most (greater ones are split)."""
    slot, slot_n = slots
    other, other_n = others
    if len(other_n) and other_n.max() > 65_535:
        times = -(-other_n // 65_535)
        last = np.cumsum(times) - 1
        other, rest = np.repeat(other, times), other_n - (times - 1) * 65_535
        other_n = np.full(len(other), 65_535)
        other_n[last] = rest
    cells = [slot.astype("<u4"), slot_n.astype("<u4"), np.bincount(other >> 32).astype("<u4"), (other & 0xFFFFFFFF).astype("<u4"), other_n.astype("<u2")]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], schema=_NEAR)


def _cells(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
    """slot, slot_n, at, other, other_n of a row."""
    slot, slot_n, at_n, other, other_n = (np.frombuffer(batch.column(i)[k].as_buffer(), "<u2" if i == 5 else "<u4") for i in range(1, 6))
    return slot, slot_n.astype(np.int64), np.repeat(np.arange(len(at_n), dtype=np.int32), at_n), other, other_n


def count_neighbours(coded: DataFrame, fixed: np.ndarray, middle: Middle, width: int) -> tuple[DataFrame, np.ndarray]:
    """Neighbours of the middle words, and counts of class after class where both words have a fixed class.

    A row of the first is one part: ``slot``, place * (2 * width + 1) + a class before it, width + a class after it,
    or 2 * width for the word itself; and for neighbours of the middle, ``at``, 2 * place + side, and ``other``.
    """
    spark, n, per = coded.sparkSession, middle, 2 * width + 1
    sent = spark.sparkContext.broadcast(fixed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, between, held, size = sent.value, np.zeros(width * width, np.int64), [], 0
        last = len(of) - 1

        def out() -> Iterator[pa.RecordBatch]:
            flat = np.concatenate(held)
            held.clear()
            prev, cur = flat[:-1].astype(np.int64), flat[1:].astype(np.int64)
            middle_prev, middle_cur = ((x >= n.first) & (x < n.first + n.n) for x in (prev, cur))
            both = ~middle_prev & ~middle_cur
            between[:] += np.bincount(of[prev[both]].astype(np.int64) * width + of[cur[both]], minlength=width * width)
            slots, others = [], []
            for side, owner, other, mine, theirs in ((0, cur, prev, middle_cur, middle_prev), (1, prev, cur, middle_prev, middle_cur)):
                mark = mine & ~theirs
                i = owner[mark] - n.first
                slots.append((i % n.parts * n.size + i // n.parts) * per + side * width + of[other[mark]])
                mark = mine & theirs & (prev != cur)
                i = owner[mark] - n.first
                others.append(((i % n.parts * n.size + i // n.parts) * 2 + side) << 32 | other[mark])
            i = prev[middle_prev & (prev == cur)] - n.first
            slots.append((i % n.parts * n.size + i // n.parts) * per + 2 * width)
            slot, slot_n = np.unique(np.concatenate(slots), return_counts=True)
            other, other_n = np.unique(np.concatenate(others), return_counts=True)
            edges = np.arange(n.parts + 1) * n.size
            a, b = np.searchsorted(slot, edges * per), np.searchsorted(other, edges * 2 << 32)
            for p in np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)):
                yield _near_row(int(p), (slot[a[p] : a[p + 1]] - p * n.size * per, slot_n[a[p] : a[p + 1]]), (other[b[p] : b[p + 1]] - (int(p) * n.size * 2 << 32), other_n[b[p] : b[p + 1]]))

        for batch in slices(batches):
            flat = _flat(batch.column(0), 0, 1, last)
            held.append(np.concatenate([[np.int32(last)], flat]) if not held else flat)
            size += len(flat)
            if size > 2_000_000:
                yield from out()
                size = 0
        if held:
            yield from out()
        codes = np.flatnonzero(between)
        yield _near_row(-1, (codes, between[codes]), (np.empty(0, np.int64), np.empty(0, np.int64)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, slots, others, size = None, [], [], 0

        def fold() -> None:
            slots[:], others[:] = ([_summed([x for x, _ in y], [x for _, x in y])] for y in (slots, others))

        for batch in batches:
            for k, p in enumerate(batch.column(0).to_pylist()):
                if p != part and part is not None:
                    fold()
                    yield _near_row(part, slots[0], others[0])
                    slots, others, size = [], [], 0
                part = p
                slot, slot_n, at, other, other_n = _cells(batch, k)
                slots.append((slot.astype(np.int64), slot_n))
                others.append((at.astype(np.int64) << 32 | other, other_n.astype(np.int64)))
                size += len(slot) + len(at)
                if size > 3_000_000:
                    fold()
                    size = (len(slots[0][0]) + len(others[0][0])) // 2
        if part is not None:
            fold()
            yield _near_row(part, slots[0], others[0])

    counted = written(coded.select("codes").mapInArrow(run, _NEAR_SQL).where("part >= 0 OR length(slot) > 0").repartition(n.parts + 1, "part").sortWithinPartitions("part").mapInArrow(merge, _NEAR_SQL))
    between = np.zeros((width, width), np.int64)
    for r in counted.where("part < 0").collect():  # one row
        between.ravel()[np.frombuffer(r["slot"], "<u4")] = np.frombuffer(r["slot_n"], "<u4")
    return counted.where("part >= 0"), between


def exchange_middle(near: DataFrame, between: np.ndarray, start: np.ndarray, middle: Middle, width: int, tolerance: float = TOLERANCE) -> np.ndarray:
    """Classes of all types after moving those of the middle, from ``start`` on; the others stay.

    near, between: as count_neighbours gives them. Each round moves half of the words, alternately.
    """
    spark, n, per = near.sparkSession, middle, 2 * width + 1
    now, rounds = start.copy(), Rounds(tolerance)
    sides = slice(0, width), slice(width, 2 * width)

    for round_ in range(MOST_ROUNDS):
        sent = spark.sparkContext.broadcast(now)

        def counts(batch: pa.RecordBatch, k: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Types of a part, their counts by slot, and those before them of fixed classes alone."""
            types = n.types(batch.column(0)[k].as_py())
            slot, slot_n, at, other, other_n = _cells(batch, k)
            x = np.zeros(len(types) * per)
            x[slot] = slot_n
            alone = x.reshape(-1, per)[:, sides[0]].copy()
            for i in range(0, len(at), 500_000):
                some = slice(i, i + 500_000)
                x += np.bincount((at[some] >> 1) * per + (at[some] & 1) * width + of[other[some]], other_n[some], len(x))
            return types, x.reshape(-1, per), alone

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, total = sent.value, np.zeros((width, width))
            for batch in batches:
                for k in range(batch.num_rows):
                    types, x, alone = counts(batch, k, of)
                    own = of[types].astype(np.int64)
                    np.add.at(total, own, x[:, sides[1]])
                    np.add.at(total, (own, own), x[:, -1])
                    np.add.at(total.T, own, alone)
            cells = np.flatnonzero(total)
            yield _rows(["cell", "n"], [cells.astype(np.int32), np.rint(total.ravel()[cells]).astype(np.int64)])

        whole = between.copy()
        for cell, c in near.mapInArrow(sums, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect():
            whole.ravel()[cell] += c
        if rounds.ended(whole, now):
            break
        matrix = spark.sparkContext.broadcast(whole)

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = sent.value
            for batch in batches:
                for k in range(batch.num_rows):
                    types, x, _ = counts(batch, k, of)
                    moved = []
                    for i in np.flatnonzero((types // n.parts) % 2 == round_ % 2):
                        own = int(of[types[i]])
                        to, gain = best_classes(own, x[i, sides[0]], x[i, sides[1]], x[i, -1], matrix.value)
                        if gain > 1e-6:
                            moved.append((types[i], to))
                    if moved:
                        kind, to = np.array(moved).T
                        yield _rows(["type", "to"], [kind.astype(np.int32), to.astype(np.int32)])

        moves = near.mapInArrow(move, "type int, to int").toArrow()
        now = now.copy()
        now[moves["type"].to_numpy()] = moves["to"].to_numpy()
    return rounds.best


def transitions(trigrams: np.ndarray) -> np.ndarray:
    """log10 P(c | a, b) from counts [a, b, c], by deleted interpolation of three orders."""
    f3, f2, f1 = trigrams.astype(float), trigrams.sum(0).astype(float), trigrams.sum((0, 1)).astype(float)
    h2, h1, n = f3.sum(2), f2.sum(1), f1.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        left_out = np.stack([np.nan_to_num((f3 - 1) / (h2[:, :, None] - 1), posinf=0), np.broadcast_to(np.nan_to_num((f2 - 1) / (h1[:, None] - 1), posinf=0), f3.shape), np.broadcast_to((f1 - 1) / max(n - 1, 1), f3.shape)])
    chosen = left_out.argmax(0)
    weight = np.array([f3[chosen == i].sum() + 1 for i in range(3)])
    weight /= weight.sum()
    p1 = (f1 + 0.5) / (n + 0.5 * len(f1))
    p2 = np.where(h1[:, None] > 0, f2 / np.maximum(h1[:, None], 1), p1)
    p3 = np.where(h2[:, :, None] > 0, f3 / np.maximum(h2[:, :, None], 1), p2[None])
    return np.log10(weight[0] * p3 + weight[1] * p2[None] + weight[2] * p1)


class Model:
    """What is learnt from the training texts; see ``fit``."""

    total: int
    distinct: int
    ends: int
    lexicon: DataFrame  # (word, c, type): words that are not sent; type is null but for words of the core
    top: list[tuple[bytes, int, int]]  # (word, c, type) of the words sent
    whole: bool  # whether all words of the core are sent
    n_core: int
    n_head: int
    mass: np.ndarray  # tokens of each type
    once: np.ndarray  # words of each ending seen once
    ending: np.ndarray  # of each word of the core
    of_type: np.ndarray  # classes
    steps: np.ndarray  # transitions


def _least(levels: list[tuple[int, int]], most: int, lowest: int) -> Column:
    """Whether a word is among the ``most`` with the greatest counts, by whole levels of counts, and has ``lowest``."""
    room, least = most, None
    for level, n in sorted(levels, reverse=True):
        room -= n
        if room < 0:
            break
        least = level
    chosen = F.col("c") >= lowest
    return chosen if room >= 0 else chosen & (F.floor(F.log2("c") * 8) >= F.lit(least)) if least is not None else F.lit(False)


def learn_words(train: DataFrame, min_count: int, head_share: float, most_sent: int, most_core: int = MOST_CORE) -> Model:
    """The part of the model that words alone make: counts, types, and which words are sent."""
    m = Model()
    vocabulary = written(count_words(train))
    m.total, m.distinct, m.ends = (x or 0 for x in vocabulary.agg(F.sum("c"), F.count("*"), F.max(F.when(F.col("word") == END, F.col("c")))).first())
    rows = vocabulary.where(F.col("word") != END)
    levels = [tuple(r) for r in rows.where(F.col("c") >= min_count).groupBy(F.floor(F.log2("c") * 8).alias("level")).agg(F.count("*")).collect()]
    in_core = _least(levels, most_core, min_count)
    in_head = in_core & (F.col("c") >= head_share * m.total)
    order = Window.orderBy(F.desc("c"), "word")
    head = rows.where(in_head).select("word", "c", (F.row_number().over(order) - 1).cast("int").alias("type"))  # 1 / head_share at most
    m.n_head = head.count()
    buckets = 256
    spread = rows.where(in_core & ~in_head).withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int"))
    sizes = {r["bucket"]: r["n"] for r in spread.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    before = (np.cumsum([0, *(sizes.get(i, 0) for i in range(buckets))]) + m.n_head).tolist()
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("word")) - 1
    others = spread.select("word", "c", (F.element_at(F.lit(before), F.col("bucket") + 1) + within).cast("int").alias("type"))
    core = written(head.unionByName(others))
    m.n_core = before[-1]

    def ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings = Endings()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([endings[w] for w in batch.column(0).to_pylist()], pa.int32())], [*batch.schema.names[1:], "ending"])

    m.mass, m.once, m.ending = np.zeros(m.n_core + ENDINGS + 1), np.zeros(ENDINGS), np.zeros(m.n_core, np.int32)
    known = core.mapInArrow(ending, "c long, type int, ending int").toArrow()  # most_core at most
    m.mass[known["type"].to_numpy()], m.ending[known["type"].to_numpy()] = known["c"].to_numpy(), known["ending"].to_numpy()
    rare = rows.where(~in_core).mapInArrow(ending, "c long, ending int")
    for e, c, n in rare.groupBy("ending").agg(F.sum("c"), F.count(F.when(F.col("c") == 1, 1))).collect():
        m.mass[m.n_core + e], m.once[e] = c, n
    m.mass[-1] = m.ends
    in_sent = _least(levels, most_sent, min_count)
    top = core.where(in_sent | (F.col("type") < m.n_head)).toArrow()
    m.top = list(zip(*(top[c].to_pylist() for c in ("word", "c", "type")), strict=True))
    m.whole = len(m.top) == m.n_core
    rest = rows.where(~in_core).withColumn("type", F.lit(None).cast("int"))
    m.lexicon = rest if m.whole else rest.unionByName(core.where(~in_sent & (F.col("type") >= m.n_head)))
    return m


CODED = "row long, doc_id long, held_out boolean, codes binary, n_known long, base double, emit double, at int, word binary, ending int"


def encode(rows: DataFrame, m: Model) -> tuple[DataFrame, DataFrame]:
    """(texts as types, with sums over words sent; words that are not sent, joined with the lexicon).

    The first: row, doc_id, held_out, codes (int32 bytes), n_known, base, emit. The second: row, at, ending, c, type.
    """
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(m.top)
    smooth, n_core, whole, ends = m.total + 0.5 * (m.distinct + 1), m.n_core, m.whole, m.ends
    names = ["row", "doc_id", "held_out", "codes", "n_known", "base", "emit", "at", "word", "ending"]
    fields = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.int32()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, endings = Places((w, i) for i, (w, _, _) in enumerate(sent.value)), Endings()
        counts = np.array([c for _, c, _ in sent.value] + [0], float)
        types = np.array([t for _, _, t in sent.value] + [0], np.int32)
        base, emit = np.log10((counts + 0.5) / smooth), np.log10(counts + 0.5)
        base[-1] = emit[-1] = 0  # what a place of -1 finds
        for batch in slices(batches):
            each = [words(t) for t in utf8(batch.column(1))]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            flat = list(chain.from_iterable(each))
            at = np.fromiter(map(places.__getitem__, flat), np.int64, len(flat))
            owner = np.repeat(np.arange(len(each)), sizes)
            rest = np.flatnonzero(at < 0)
            rest_words = [flat[i] for i in rest.tolist()]
            groups = np.fromiter(map(endings.__getitem__, rest_words), np.int32, len(rest_words))
            codes = types[at]
            codes[rest] = n_core + groups if whole else -1 - groups  # below 0: the lexicon may know better
            packed, edges = codes.tobytes(), np.append(0, np.cumsum(sizes)) * 4
            edges = edges.tolist()
            n = len(each)
            row_ids = batch.column(3)
            yield pa.RecordBatch.from_arrays(
                [row_ids, batch.column(0), batch.column(2), pa.array([packed[a:b] for a, b in zip(edges, edges[1:])], pa.binary()), pa.array(np.bincount(owner[at >= 0], minlength=n) + (ends > 0), pa.int64()),
                 pa.array(np.bincount(owner, base[at], n) + np.log10((ends + 0.5) / smooth)), pa.array(np.bincount(owner, emit[at], n)), *(pa.nulls(n, f.type) for f in list(fields)[7:])],
                schema=fields,
            )
            if len(rest):
                place = (rest - (np.cumsum(sizes) - sizes)[owner[rest]]).astype(np.int32)
                given = {"row": row_ids.take(pa.array(owner[rest])), "at": pa.array(place), "word": pa.array(rest_words, pa.binary()), "ending": pa.array(groups)}
                yield pa.RecordBatch.from_arrays([given.get(f.name, pa.nulls(len(rest), f.type) if f.name not in given else None) for f in fields], schema=fields)

    both = written(rows.select("doc_id", "text", "held_out", F.monotonically_increasing_id().alias("row")).mapInArrow(run, CODED))
    coded = both.where("codes IS NOT NULL").select("row", "doc_id", "held_out", "codes", "n_known", "base", "emit")
    rest = both.where("codes IS NULL").select("row", "at", "word", "ending").join(m.lexicon, "word", "left").drop("word")
    if whole:
        return coded, rest
    rest = written(rest)
    found = rest.where("type IS NOT NULL").groupBy("row").agg(F.collect_list("at").alias("ats"), F.collect_list("type").alias("types"))  # words of one text

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for codes, ats, types in zip(*(batch.column(i).to_pylist() for i in (3, 7, 8)), strict=True):
                x = np.frombuffer(codes, np.int32).copy()
                x[ats or []] = types or []
                out.append(np.where(x < 0, n_core - 1 - x, x).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary()), *batch.columns[4:7]], batch.schema.names[:7])

    joined = coded.join(found, "row", "left")
    return written(joined.mapInArrow(fill, coded.schema)), rest


def learn_classes(m: Model, coded: DataFrame, classes: int, tolerance: float = TOLERANCE) -> None:
    """Classes of all types by exchange, and transitions between classes, from the training texts ``coded``."""
    n_types, width, end = len(m.mass), classes + 1, len(m.mass) - 1
    coarse = np.concatenate([np.arange(m.n_head), m.n_head + m.ending[m.n_head :], m.n_head + np.arange(ENDINGS + 1)]).astype(np.int32)
    counts = np.bincount(coarse, m.mass, m.n_head + ENDINGS + 1)
    now = exchange(written(count_bigrams(coded, coarse)), counts, classes, tolerance)[coarse].astype(np.uint8)
    if m.n_core > m.n_head:
        middle = Middle(m.n_head, m.n_core - m.n_head, m.total)
        near, between = count_neighbours(coded, now, middle, width)
        now = exchange_middle(near, between, now, middle, width, tolerance)
    m.of_type = now
    sent = coded.sparkSession.sparkContext.broadcast(now)

    def make(codes: pa.Array) -> np.ndarray:
        flat = sent.value[_flat(codes, 2, 1, end)].astype(np.int64)
        inside = np.ones(len(flat), bool)
        sizes = np.array([len(x) // 4 + 3 for x in codes.to_pylist()])
        first = np.cumsum(sizes) - sizes
        inside[first] = inside[first + 1] = False
        return ((flat[:-2] * width + flat[1:-1]) * width + flat[2:])[inside[2:]]

    trigrams = np.zeros((width, width, width), np.int64)
    for a, b, c, n in _count_codes(coded, make, width, ["a", "b", "c", "n"]).collect():  # classes^3 at most
        trigrams[a, b, c] = n
    m.steps = transitions(trigrams).astype(np.float32)
    assert n_types == len(now)


def score(docs: DataFrame, classes: int = CLASSES, min_count: int = MIN_COUNT, head_share: float = HEAD_SHARE, most_sent: int = MOST_SENT, tolerance: float = TOLERANCE) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows with crc32(doc_id as text) mod 5 other than 1 (a null id counts as empty text).
    Null and empty texts have one token, their end. Repeated rows count and are scored each for itself. Other
    columns are ignored. An empty table gives no rows. A table without training rows gives base scores of 0 each and
    a uniform class model. classes: 254 at most.
    """
    return fit_and_score(docs, classes, min_count, head_share, most_sent, tolerance)[1]


def fit_and_score(docs: DataFrame, classes: int, min_count: int, head_share: float, most_sent: int, tolerance: float) -> tuple[Model, DataFrame]:
    """The model as well as the scores."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), held.alias("held_out"))
    m = learn_words(rows.where(~F.col("held_out")), min_count, head_share, most_sent)
    coded, rest = encode(rows, m)
    learn_classes(m, coded.where(~F.col("held_out")), classes, tolerance)

    of_type, width, end = m.of_type, classes + 1, len(m.mass) - 1
    room = np.log10(np.maximum(np.bincount(of_type, m.mass, width) + 0.5 * np.bincount(of_type, minlength=width), 0.5))
    room[-1] = 0  # the end is alone in its class
    mass = m.mass[m.n_core : -1]
    unknown = np.where(mass > 0, (m.once + 0.5) / (mass + 1), 1.0)
    with np.errstate(divide="ignore"):
        if_unknown, if_known = np.log10(mass + 0.5) + np.log10(unknown), np.log10(mass + 0.5) + np.log10((1 - unknown) / np.maximum(mass, 1))
    sent = coded.sparkSession.sparkContext.broadcast((of_type, m.steps - room.astype(np.float32)[None, None, :]))
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, steps = sent.value
        for batch in slices(batches):
            codes = batch.column(3)
            sizes = np.array([len(x) // 4 for x in codes.to_pylist()])
            path = of[_flat(codes, 2, 1, end)].astype(np.int64)
            each = steps[path[:-2], path[1:-1], path[2:]].astype(float)
            first = np.cumsum(sizes + 3) - (sizes + 3)
            total = np.append(0, np.cumsum(each))
            value = total[first + sizes + 1] - total[first]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes + 1), batch.column(4), batch.column(5), pa.array(value + batch.column(6).to_numpy())], names)

    scored = coded.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, value double")
    smooth = m.total + 0.5 * (m.distinct + 1)
    by_ending = lambda x: F.element_at(F.lit(x.tolist()), F.col("ending") + 1)
    own = F.when(F.col("type").isNotNull(), F.log10(F.col("c") + 0.5)).when(F.col("c").isNotNull(), by_ending(if_known) + F.log10("c")).otherwise(by_ending(if_unknown))
    more = rest.groupBy("row").agg(F.count("c").alias("more_known"), F.sum(F.log10((F.coalesce("c", F.lit(0)) + 0.5) / smooth)).alias("more_base"), F.sum(own).alias("more_value"))
    out = scored.join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(m.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("value") + F.coalesce("more_value", F.lit(0.0))).alias("score"),
    )
    return m, out


def op2_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
