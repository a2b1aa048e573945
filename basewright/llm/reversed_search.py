"""Ranked lexical search the other way round: documents are streamed through an index of the queries.

The items are few beside the documents, so they are what is indexed: each term leads to the items that hold it. The
index is broadcast in blocks of a bounded number of postings; a larger item table takes one pass a block. A pass reads
the texts once and writes, for each document, its length and the codes and counts of its terms that some item has.
Counts of documents, terms and document frequencies are sums over that table. Then its rows run through the index: a
document's term weights are added up per item, and each task keeps a heap of the best documents for every item. The
heaps of all tasks, never more than ``best`` entries each, are merged by item.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewright.llm.common import slices, table, text_or_empty, utf8, written

BEST = 10
#: Postings in one broadcast block of the index, but for a single item that has more.
MOST_POSTINGS = 1 << 20
#: Scores held at a time, documents by items.
CELLS = 1 << 21
#: Every ASCII byte that is no letter or digit parts terms; A-Z are lower-cased; bytes of other characters stay.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, with repeats."""
    return text.translate(FOLD).split()


def _item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms): distinct terms of each distinct row that has any, numbered by ``item``."""
    fields = pa.schema([("item_id", pa.int64()), ("terms", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            each = [sorted(set(terms(text))) for text in utf8(batch.column(1))]
            held = [k for k, x in enumerate(each) if x]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held, pa.int64())), pa.array([each[k] for k in held], fields[1].type)], schema=fields)

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).distinct()
    return rows.mapInArrow(run, "item_id long, terms array<binary>").withColumn("item", F.monotonically_increasing_id())


def _blocks(index: DataFrame, most: int) -> DataFrame:
    """``index`` with the number of each item's block, by running sums of its postings within and over partitions."""
    rows = index.withColumn("_part", F.shiftright("item", 33)).withColumn("_n", F.size("terms").cast("long"))
    sums = rows.groupBy("_part").agg(F.sum("_n").alias("_sum"))  # a row a partition
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    running = F.col("_before") + F.sum("_n").over(Window.partitionBy("_part").orderBy("item")) - F.col("_n")
    return rows.join(sums, "_part").withColumn("block", F.floor(running / most).cast("int")).drop("_part", "_n", "_before")


def _counted(docs: DataFrame, codes: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, codes, counts): of each document its number of terms and those that have a code."""
    sent = docs.sparkSession.sparkContext.broadcast(codes)
    fields = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("codes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = sent.value.get
        for batch in slices(batches):
            sizes, found, times, ends = [], [], [], [0]
            for text in utf8(batch.column(1)):
                words = terms(text)
                known = np.fromiter(map(code, words, repeat(-1)), np.int32, len(words))
                some, counts = np.unique(known[known >= 0], return_counts=True)
                sizes.append(len(words))
                found.append(some)
                times.append(counts)
                ends.append(ends[-1] + len(some))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *x]).astype(np.int32))) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], schema=fields)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, codes array<int>, counts array<int>")


def _frequencies(counted: DataFrame, n_codes: int) -> np.ndarray:
    """How many documents hold each code: what a task has counted is summed by code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(n_codes, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_codes)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(held[some])], ["code", "df"])

    sums = counted.select("codes").mapInArrow(run, "code int, df long").groupBy("code").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(n_codes, np.int64)
    out[sums["code"].to_numpy()] = sums["df"].to_numpy()
    return out


class Heaps:
    """The best (score, document) of each item; equal scores go by ascending id, null last."""

    def __init__(self, n_items: int, best: int):
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(n_items)]
        self.least = np.ones(n_items, np.int64)  # what a score must reach
        self.best = best

    def offer(self, scores: np.ndarray, doc_ids: list[int | None]) -> None:
        """scores [documents, items]"""
        reach = self.least
        if len(scores) > self.best:  # only what is among the best of these documents
            reach = np.maximum(reach, np.partition(scores, -self.best, axis=0)[-self.best])
        for d, i in zip(*np.nonzero(scores >= reach), strict=True):
            heap, doc_id = self.heaps[i], doc_ids[d]
            entry = (int(scores[d, i]), -(1 << 63) if doc_id is None else -doc_id)
            if len(heap) < self.best:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            else:
                continue
            if len(heap) == self.best:
                self.least[i] = heap[0][0]


def _heaps(counted: DataFrame, weights: np.ndarray, starts: np.ndarray, postings: np.ndarray, n_items: int, n_docs: int, n_terms: int, best: int) -> DataFrame:
    """(at, doc_id, score): the entries of each task's heaps. starts, postings: the items ``at`` of each code."""
    sent = counted.sparkSession.sparkContext.broadcast((weights, starts, postings))
    fields = pa.schema([("at", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, starts, postings = sent.value
        heaps = Heaps(n_items, best)
        for batch in slices(batches, max(1, CELLS // n_items)):
            doc_ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lengths = np.array([100 - 90 + 90 * n * n_docs // n_terms for n in sizes], np.int64)  # m
            held = np.diff(np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))]))
            codes, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3))
            owner = np.repeat(np.arange(len(doc_ids)), held)
            value = weights[codes] * (1_000_000_000 * counts // (1000 * counts + 8 * lengths[owner]))
            scores = np.zeros((len(doc_ids), n_items), np.int64)
            flat, wide = scores.ravel(), starts[codes + 1] - starts[codes]
            ends = np.cumsum(wide)
            first = 0
            while first < len(codes):  # postings of some codes at a time
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CELLS, "right")))
                w = wide[first:last]
                nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                items = postings[np.repeat(starts[codes[first:last]], w) + nth]
                np.add.at(flat, np.repeat(owner[first:last], w) * n_items + items, np.repeat(value[first:last], w))
                first = last
            heaps.offer(scores, doc_ids)
        rows = [(i, None if x == -(1 << 63) else -x, s) for i, heap in enumerate(heaps.heaps) for s, x in heap]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)

    return counted.mapInArrow(run, "at int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, best: int = BEST, most_postings: int = MOST_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item with a score above 0, by score and doc_id.

    Terms are runs of ASCII letters, digits and other characters; only A-Z are lower-cased. Null text has none, an
    item or document without terms is in no row, and no items or no documents give no rows. Every row of ``docs`` is
    a document of its own; of equal scores the lesser id goes first, null last, and rows that repeat an id and score
    are alike in the result. Rows of ``items`` that repeat id and text are one item; rows of one id with different
    texts, and null ids, are ranked each by itself. Other columns are ignored.
    """
    spark = docs.sparkSession
    index = written(_blocks(written(_item_terms(items)), most_postings))
    results = []
    for block in range((index.agg(F.max("block")).first()[0] or 0) + 1):
        some = index.where(F.col("block") == block)
        held = some.select("item", "terms").toArrow()  # at most most_postings terms, or one item
        at = {item: k for k, item in enumerate(held["item"].to_pylist())}
        if not at:
            continue
        each = held["terms"].to_pylist()
        codes = {t: k for k, t in enumerate(sorted({t for x in each for t in x}))}
        pairs = np.array([(codes[t], k) for k, x in enumerate(each) for t in x], np.int64)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        starts = np.searchsorted(pairs[:, 0], np.arange(len(codes) + 1))
        counted = written(_counted(docs, codes))
        n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            continue
        df = _frequencies(counted, len(codes)).tolist()
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df], np.int64)
        entries = _heaps(counted, weights, starts, pairs[:, 1], len(at), n_docs, n_terms, best)
        numbers = spark.createDataFrame(pa.table({"at": pa.array(range(len(at)), pa.int32()), "item": held["item"]})).join(some.select("item", "item_id"), "item")
        order = Window.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = entries.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        results.append(top.join(F.broadcast(numbers), "at").select("item_id", "rank", "doc_id", "score"))  # a row an item
    return reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS t FROM documents),
  tf AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
  st AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
  it AS (SELECT DISTINCT item_id, text, unnest({_TERMS}) AS term FROM benchmark),
  w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), st),
  ln AS (SELECT r, 10 + (90 * len(t) * n_docs) // n_terms AS m FROM d, st WHERE len(t) > 0),
  sc AS (SELECT item_id, text, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM it JOIN tf USING (term) JOIN w USING (term) JOIN ln USING (r) GROUP BY ALL)
  SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc WHERE score > 0) WHERE rank <= 10"""
