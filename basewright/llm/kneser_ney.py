"""Quality classifier: interpolated modified Kneser-Ney n-grams over characters, trained on trusted text.

Counting, discounts and interpolation are grouped DataFrame aggregations and joins over n-gram tables that are
sharded by n-gram. The finished model is one table of (key, value): the log-probability of each seen n-gram of
each order, and the log back-off weight of each seen context. Its most frequent entries, up to a fixed number, are
broadcast with a Bloom filter of the rest; a position that needs an entry of the rest goes through a join with the
sharded table. A document is kept if its perplexity is at most a quantile of its language's trusted text.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewright.llm.common import mix, slices, table, text_or_empty, written
from basewright.llm.containment import Filter

ORDER = 5
START, END = "\x02", "\x03"
#: Bits of the filters of ids, as a power of two, at most: 16 an id below that; a full filter costs speed.
MOST_ID_BITS = 26
#: Entries of the model that are broadcast, at most.
MOST_SENT = 1 << 20
#: Weight, in characters, of the trusted text's mean in a document's mean: short texts judge themselves less.
PRIOR_CHARS = 100
QUANTILE = 0.995
#: Languages with fewer trusted documents use the quantiles of all.
LEAST_TRUSTED = 50
#: Cells a nat in which values are counted before a quantile is looked up.
CELLS = 1 << 13

#: Powers of an odd base modulo 2^64.
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 2**64)) for k in range(16)]
_FILTER_BITS = 24
#: Characters scored at a time.
MOST_POSITIONS = 1 << 17


def _codes(text: str) -> np.ndarray:
    return mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))


def _folds(codes: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """For k = 0 .. order, a hash of the k characters that end at each position from ``order - 1`` on, unsalted."""
    out, n = [np.zeros(len(codes) - order + 1, np.uint64)], len(codes)
    for k in range(order):
        out.append(out[-1] + codes[order - 1 - k : n - k] * _POWERS[k])
    return out


def _salted(fold: np.ndarray, k: int, context: bool) -> np.ndarray:
    return mix(fold + np.uint64(1_000_003 * (2 * k + context)))


def _key_of(grams: list[str], context: bool) -> np.ndarray:
    """Keys of whole n-grams, as the scan of a text makes them."""
    out = np.zeros(len(grams), np.uint64)
    lengths = np.array([len(g) for g in grams])
    for k in np.unique(lengths):
        at = np.flatnonzero(lengths == k)
        codes = _codes("".join(grams[i] for i in at)).reshape(len(at), k) if k else np.zeros((len(at), 0), np.uint64)
        fold = np.zeros(len(at), np.uint64)
        for j in range(k - 1, -1, -1):
            fold = fold + codes[:, j] * _POWERS[k - 1 - j]
        out[at] = _salted(fold, k, context)
    return out


class Lookup:
    """An open-addressing table of uint64 keys and float32 values, read for whole arrays at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.float32)
        left, slot = np.arange(len(keys)), keys >> np.uint64(64 - self.bits)
        self.probes = 0
        while left.size:
            self.probes += 1
            free = self.keys[slot] == 0
            first = np.zeros(len(left), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            put = free & first
            self.keys[slot[put]], self.values[slot[put]] = keys[left[put]], values[left[put]]
            left, slot = left[~put], (slot[~put] + np.uint64(1)) & np.uint64((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each key."""
        slot = keys >> np.uint64(64 - self.bits)
        at = self.keys[slot]
        found, values = at == keys, self.values[slot]
        left = np.flatnonzero(~found & (at != 0))
        for _ in range(self.probes):
            if not left.size:
                break
            slot = (keys[left] >> np.uint64(64 - self.bits)) + np.uint64(_ + 1) & np.uint64((1 << self.bits) - 1)
            at = self.keys[slot]
            hit = at == keys[left]
            found[left[hit]], values[left[hit]] = True, self.values[slot[hit]]
            left = left[~hit & (at != 0)]
        return found, values


@dataclass
class Model:
    """entries(key, value): the whole table; sent: what is broadcast; rest: whether entries remain beyond it."""

    entries: DataFrame
    sent: Any
    rest: bool
    unknown: float


def count_ngrams(texts: DataFrame, order: int = ORDER, most: int = 400_000) -> DataFrame:
    """(gram, c): character n-grams of ``texts(text)`` with start and end marks, counted map-side first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["gram", "c"])
            counts.clear()
            return batch

        for batch in slices(batches, 64):
            for text in batch.column(0).to_pylist():
                padded = START * (order - 1) + text + END
                counts.update([padded[i : i + order] for i in range(len(padded) - order + 1)])
                if len(counts) > most:
                    yield out()
        yield out()

    return texts.select(text_or_empty().alias("text")).mapInArrow(run, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(grams: DataFrame) -> tuple[float, float, float]:
    """The three discounts from the numbers of n-grams seen once to four times."""
    n = dict.fromkeys(range(1, 5), 0) | {r["c"]: r["n"] for r in grams.where("c <= 4").groupBy("c").agg(F.count("*").alias("n")).collect()}
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def fit(trusted: DataFrame, order: int = ORDER, most_sent: int = MOST_SENT) -> Model:
    """The model of ``trusted(text)``. Lower orders count distinct left neighbours; the lowest mixes with a uniform
    distribution over the characters seen and one for all others. No text gives that uniform distribution alone."""
    grams = {order: written(count_ngrams(trusted, order))}
    for k in range(order - 1, 0, -1):
        grams[k] = written(grams[k + 1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c")))
    unknown = -float(np.log(grams[1].count() + 1))
    lower, parts = None, []
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(grams[k])
        g = grams[k].withColumn("context", F.expr("left(gram, length(gram) - 1)"))
        sums = [F.sum("c").alias("total"), *(F.count(F.when(x, 1)).alias(f"n{i}") for i, x in ((1, F.col("c") == 1), (2, F.col("c") == 2), (3, F.col("c") >= 3)))]
        contexts = g.groupBy("context").agg(*sums).withColumn("weight", (d1 * F.col("n1") + d2 * F.col("n2") + d3 * F.col("n3")) / F.col("total"))
        g = g.join(contexts.select("context", "total", "weight"), "context")
        own = (F.col("c") - F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)) / F.col("total")
        if lower is None:
            g = g.withColumn("p", own + F.col("weight") * float(np.exp(unknown)))
        else:
            g = g.withColumn("suffix", F.expr("substring(gram, 2)")).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), "suffix")
            g = g.withColumn("p", own + F.col("weight") * F.col("q"))
        lower = written(g.select("gram", "c", "p"))
        parts += [lower.select("gram", "c", F.log("p").alias("value"), F.lit(False).alias("context")), contexts.select(F.col("context").alias("gram"), F.col("total").alias("c"), F.log("weight").alias("value"), F.lit(True).alias("context"))]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_context = np.array(batch.column(3).to_pylist(), bool)
            names = batch.column(0).to_pylist()
            keys = np.where(is_context, _key_of(names, True), _key_of(names, False)) if names else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(1), batch.column(2)], ["key", "c", "value"])

    entries = written(reduce(DataFrame.unionByName, parts).mapInArrow(keyed, "key long, c long, value double"))
    level = F.floor(F.log2("c") * 8).cast("int")
    room, least = most_sent, 0
    for r in sorted(entries.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        room -= r["n"]
        if room < 0:
            least = r["level"] + 1
            break
    sent = entries.where(level >= least).select("key", "value").toArrow()  # most_sent rows at most
    bits = np.zeros(1 << _FILTER_BITS >> 6, np.int64)
    if room < 0:
        spot = F.shiftrightunsigned("key", 64 - _FILTER_BITS)
        for i, x in entries.where(level < least).groupBy(F.shiftright(spot, 6).cast("int").alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - _FILTER_BITS}) & 63 as int))"))).collect():
            bits[i] = x
    broadcast = entries.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, sent["key"].to_numpy().view(np.uint64), sent["value"].to_numpy().astype(np.float32), bits, order, unknown))
    return Model(entries, broadcast, room < 0, unknown)


class Scorer:
    """Scores texts with the broadcast entries."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: np.ndarray, order: int, unknown: float):
        self.lookup, self.order, self.unknown = Lookup(keys, values), order, unknown
        self.filter = np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool) if bits.any() else None

    def _maybe(self, keys: np.ndarray, found: np.ndarray) -> np.ndarray:
        return ~found & self.filter[keys >> np.uint64(64 - _FILTER_BITS)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray] | None]:
        """Per text the log-probability of its characters and end, and their number; and, for positions that need
        an entry that was not sent, (text, the 2 * order keys of the position).

        Positions are scored in groups of bounded size, long texts in parts that overlap by a context.
        """
        n = self.order
        total, counts, rest = np.zeros(len(texts)), np.array([len(t) + 1 for t in texts], np.int64), []
        parts, owners, size = [], [], 0
        for i, text in enumerate(texts):
            padded = START * (n - 1) + text + END
            for at in range(0, len(padded) - n + 1, MOST_POSITIONS):
                part = padded[at : at + MOST_POSITIONS + n - 1]
                if size + len(part) > MOST_POSITIONS and parts:
                    self._score(parts, owners, total, rest)
                    parts, owners, size = [], [], 0
                parts.append(part)
                owners.append(i)
                size += len(part)
        if parts:
            self._score(parts, owners, total, rest)
        return total, counts, tuple(map(np.concatenate, zip(*rest, strict=True))) if rest else None

    def _score(self, parts: list[str], owners: list[int], total: np.ndarray, rest: list) -> None:
        """Add the scores of the positions of ``parts`` that have a whole context before them."""
        n = self.order
        codes = _codes("".join(parts))
        sizes = np.array([len(p) for p in parts])
        starts, counts = np.cumsum(sizes) - sizes, sizes - n + 1
        ends = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        folds = [f[ends] for f in _folds(codes, n)]
        shifted = _folds(np.concatenate([codes[:1], codes]), n)  # position i is one character earlier
        before = [shifted[k][ends] for k in range(n)]
        score, left = np.zeros(len(ends)), np.arange(len(ends))
        unsure = np.zeros(len(ends), bool)
        for k in range(n, 0, -1):
            keys = _salted(folds[k][left], k, False)
            found, values = self.lookup.get(keys)
            score[left[found]] += values[found]
            if self.filter is not None:
                unsure[left[self._maybe(keys, found)]] = True
            left = left[~found]
            if not left.size:
                break
            keys = _salted(before[k - 1][left], k - 1, True)
            found, values = self.lookup.get(keys)
            score[left[found]] += values[found]
            if self.filter is not None:
                unsure[left[self._maybe(keys, found)]] = True
        score[left] += self.unknown
        owner = np.repeat(owners, counts)
        if unsure.any():
            at = np.flatnonzero(unsure)
            score[at] = 0
            rest.append((owner[at], np.stack([x for k in range(n, 0, -1) for x in (_salted(folds[k][at], k, False), _salted(before[k - 1][at], k - 1, True))], 1)))
        total += np.bincount(owner, score, len(total))


SCORING = ("log_p", "n_symbols_scored", "_row", "_keys", "_times", "_more")

_scorers: dict[str, Scorer] = {}


def _scorer(sent: Any) -> Scorer:
    """The scorer of a broadcast model; a Python worker keeps the last one it made."""
    name, *parts = sent.value
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = Scorer(*parts)
    return _scorers[name]


def score_texts(docs: DataFrame, model: Model, order: int = ORDER) -> DataFrame:
    """``docs`` with log_p (natural log of a text's probability) and n_symbols_scored; they, and the other columns of
    SCORING, which are for use within, replace namesakes.

    Null text is empty: its end alone is scored.
    """
    docs = docs.drop(*SCORING)
    sent, rest = model.sent, model.rest
    added = [("_row", pa.int64()), ("_keys", pa.list_(pa.int64())), ("_times", pa.int64()), ("log_p", pa.float64()), ("n_symbols_scored", pa.int64())]
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent)
        for batch in slices(batches, 64):
            log_p, counts, unsure = scorer([x or "" for x in batch.column(place).to_pylist()])
            nothing = [pa.nulls(batch.num_rows, t) for _, t in added[1:3]]
            own = [*batch.columns[:-1], batch.columns[-1], *nothing, pa.array(log_p), pa.array(counts, pa.int64())]
            names = [*batch.schema.names, *(n for n, _ in added[1:])]
            yield pa.RecordBatch.from_arrays(own, names)
            if unsure is not None:
                rows = batch.columns[-1].to_numpy()
                each = np.column_stack([rows[unsure[0]].view(np.uint64), unsure[1]])
                each, times = np.unique(each, axis=0, return_counts=True)
                columns = [pa.nulls(len(each), c.type) for c in batch.columns[:-1]]
                columns += [pa.array(each[:, 0].view(np.int64)), pa.array(each[:, 1:].view(np.int64).tolist(), pa.list_(pa.int64())), pa.array(times), pa.nulls(len(each), pa.float64()), pa.nulls(len(each), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), T.StructField("_row", T.LongType()), T.StructField("_keys", T.ArrayType(T.LongType())), T.StructField("_times", T.LongType()), T.StructField("log_p", T.DoubleType()), T.StructField("n_symbols_scored", T.LongType())])
    scored = docs.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(run, schema)
    if not rest:
        return scored.drop("_row", "_keys", "_times")
    scored = written(scored)
    need = scored.where("_keys IS NOT NULL").select("_row", "_times", F.xxhash64("_keys").alias("_position"), F.posexplode("_keys").alias("slot", "key"))
    got = need.join(model.entries.select("key", "value"), "key", "left")
    slots = got.groupBy("_row", "_position").agg(F.first("_times").alias("_times"), *(F.max(F.when(F.col("slot") == i, F.col("value"))).alias(f"v{i}") for i in range(2 * order)))
    value = F.lit(model.unknown)
    for k in range(order - 1, -1, -1):  # slot 2k: the n-gram of order - k characters; 2k + 1: its context's weight
        value = F.coalesce(F.col(f"v{2 * k}"), F.coalesce(F.col(f"v{2 * k + 1}"), F.lit(0.0)) + value)
    more = slots.groupBy("_row").agg(F.sum(value * F.col("_times")).alias("_more"))
    whole = scored.where("_keys IS NULL").join(more, "_row", "left")
    return whole.withColumn("log_p", F.col("log_p") + F.coalesce("_more", F.lit(0.0))).drop("_row", "_keys", "_times", "_more")


def quantiles(values: DataFrame, share: float) -> DataFrame:
    """(every, lang, n, lowest) for ``values(lang, value)``: the exact quantile, interpolated, of each language, and of
    all in the row with ``every``. Values are counted by cells, and only those of a cell that holds a rank are ordered."""
    both = F.array(F.struct(F.lit(False).alias("every"), "lang"), F.struct(F.lit(True).alias("every"), F.lit("").alias("lang")))
    each = values.select(F.inline(both), "value").groupBy("every", "lang", "value").agg(F.count("*").alias("c"))
    each = written(each.withColumn("cell", F.floor(F.col("value") * CELLS)))
    by = Window.partitionBy("every", "lang")
    cells = each.groupBy("every", "lang", "cell").agg(F.sum("c").alias("m"))
    cells = cells.withColumns({"before": F.sum("m").over(by.orderBy("cell")) - F.col("m"), "n": F.sum("m").over(by)})
    cells = cells.withColumn("at", (F.col("n") - 1) * F.lit(share))
    cells = cells.where((F.col("before") <= F.ceil("at")) & (F.col("before") + F.col("m") > F.floor("at")))
    ranked = each.join(F.broadcast(cells), ["every", "lang", "cell"])  # two cells a language at most
    end = F.col("before") + F.sum("c").over(Window.partitionBy("every", "lang", "cell").orderBy("value"))
    ranked = ranked.withColumn("end", end)
    below, above = (F.max(F.when((F.col("end") - F.col("c") <= r) & (F.col("end") > r), F.col("value"))) for r in (F.floor("at"), F.ceil("at")))
    ends = ranked.groupBy("every", "lang", "n", "at").agg(below.alias("below"), above.alias("above"))
    share_above = F.col("at") - F.floor("at")
    return ends.select("every", "lang", "n", ((1 - share_above) * F.col("below") + share_above * F.col("above")).alias("lowest"))


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE, most_sent: int = MOST_SENT) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` with perplexity, judged, limit and kept.

    trusted(text, lang): trusted rows, all of which are used. Half of them (by a hash of the text) train the model, the
    other half set the limits. judged: the perplexity with PRIOR_CHARS characters of the trusted mean added; kept: it is
    at most the limit, the quantile of its language, or of all where the language has fewer than LEAST_TRUSTED
    documents or is null. Nothing trusted: everything is kept. Namesakes among the other columns, and those of
    SCORING, are replaced. An empty table stays empty.
    """
    even = F.pmod(F.xxhash64(text_or_empty()), F.lit(2)) == 0
    model = fit(trusted.where(even), most_sent=most_sent)
    held = written(score_texts(trusted.where(~even).select(text_or_empty().alias("text"), F.coalesce("lang", F.lit("")).alias("lang")), model).select("lang", "log_p", "n_symbols_scored"))
    mean = held.agg(F.sum("log_p") / F.sum("n_symbols_scored")).first()[0] or 0.0
    judged = (F.col("log_p") + PRIOR_CHARS * mean) / (F.col("n_symbols_scored") + PRIOR_CHARS)
    found = written(quantiles(held.select("lang", judged.alias("value")), 1 - quantile))
    every = next((r["lowest"] for r in found.where("every").collect()), None)
    limits = found.where(~F.col("every") & (F.col("n") >= LEAST_TRUSTED))
    limits = limits.select(F.col("lang").alias("_lang"), F.col("lowest").alias("_lowest"))
    out = score_texts(docs.drop("perplexity", "judged", "limit", "kept", "_lang", "_lowest"), model)
    out = out.join(F.broadcast(limits), F.col("lang") == F.col("_lang"), "left")  # a row for every LEAST_TRUSTED held texts at most
    least = F.coalesce("_lowest", F.lit(every).cast("double"))
    out = out.withColumns({"perplexity": F.exp(-F.col("log_p") / F.col("n_symbols_scored")), "judged": F.exp(-judged), "limit": F.exp(-least), "kept": F.coalesce(judged >= least, F.lit(True))})
    return out.drop("_lang", "_lowest", "log_p", "n_symbols_scored")


def _id_filter(ids: DataFrame) -> Any:
    """A broadcast Bloom filter of ``ids(doc_id)``."""
    bits = min(MOST_ID_BITS, max(min(16, MOST_ID_BITS), (16 * ids.count()).bit_length()))
    return ids.sparkSession.sparkContext.broadcast(Filter.of(ids.select(F.xxhash64("doc_id").alias("key")), bits))


def trusted_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, lang) of all documents labelled good and not toxic, written.

    Texts are not shuffled: a filter of the trusted ids, of bounded size, takes rows, and an exact join of the ids it
    takes finds the others among them, which a second filter holds. Rows that only the first holds are trusted for
    certain; those that both hold, a few unless a filter is full, are joined exactly.
    """
    ids = labels.where("quality = 1 AND toxic = 0").select(F.col("doc_id").cast("long").alias("doc_id"))
    ids = written(ids.where("doc_id IS NOT NULL").distinct())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    first = _id_filter(ids)

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0]).take(pa.array(first.value.holds(batch.column(1).to_numpy().view(np.uint64))))

    some = rows.select("doc_id", F.xxhash64("doc_id").alias("key")).mapInArrow(taken, "doc_id long")
    second = _id_filter(written(some.distinct().join(ids, "doc_id", "left_anti")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = batch.column(3).to_numpy().view(np.uint64)
            at = first.value.holds(keys)
            sure = np.ones(len(at), bool)
            sure[second.value.holds(keys[at])] = False
            columns = [*batch.select(range(3)).take(pa.array(at)).columns, pa.array(sure)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:3], "sure"])

    schema = T.StructType([*rows.schema.fields, T.StructField("sure", T.BooleanType())])
    found = written(rows.withColumn("key", F.xxhash64("doc_id")).mapInArrow(run, schema))
    joined = written(found.where("NOT sure").join(ids, "doc_id", "left_semi").select("text", "lang"))
    return found.where("sure").select("text", "lang").unionByName(joined)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, trusted_documents(docs, labels))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality(docs, table(spark, sf_dir, "labels")).drop("text")
