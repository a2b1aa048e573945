"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the power of two of their shingle count, [s, 2s). A document is cut, for each size class
that occurs, into blocks of 2s shingles, and item and block are compared by single MinHash values. Say a share c
of an item's shingles lies in the document. The item's least shingle under one hash function lies in the document
with probability c and is then the least of its block as well with at least 1/3, for item and block have at most
3s shingles together and the item has s. So one function finds the item with at least c/3, wherever in the
document its shingles stand, and 32 functions miss it with (1 - 0.8/3)^32 < 5e-5 at c = 0.8. Comparing whole long
documents would need thousands.

Items of fewer than five words have no such shingle. They are runs of one to four words, looked up at every place of
a document by their own length.

Keys of both sides, (size class, function, value), are joined, and every candidate is verified by exact containment
over the whole document. Documents are read and cut into shingles once, however many items there are: a Bloom filter
of the items' keys, of bounded size, is all that is broadcast, and only documents with keys in it leave the scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import SHINGLE_WORDS, SIMILARITY, WordHashes, mix, shingles, slices, small_batches, table, text_or_empty, utf8, window_hashes, written

FUNCTIONS = 32
#: Bits of the filter as powers of two: 64 a key, within these; a full filter costs speed, not results.
LEAST_BITS, MOST_BITS = 22, 28
PROBES = 3
#: Items of n < SHINGLE_WORDS words have the size class -n, and as keys' class this and n, which no other has.
RUNS = 64


def _functions(n: int) -> np.ndarray:
    return np.random.default_rng(20_240_502).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least(h: np.ndarray, m: np.uint64) -> np.ndarray:
    x = h * m
    return x ^ (x >> np.uint64(29))


def _key(low: np.ndarray, size_class: int, function: int) -> np.ndarray:
    return mix(low + np.uint64(size_class << 16 | function))


def item_sets(items: DataFrame, functions: int, least_run: int = 1) -> DataFrame:
    """(item_id, text_key, size_class, sets, keys) of the items with words: shingle set and keys, as uint64 bytes."""
    multipliers = _functions(functions)
    fields = pa.schema([("item_id", pa.int64()), ("text_key", pa.binary()), ("size_class", pa.int32()), ("sets", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            out = []
            for i, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                n = len(text.split())
                if len(s := shingles(text, hashes)):
                    c = -n if least_run <= n < SHINGLE_WORDS else len(s).bit_length()
                    keys = _key(s, RUNS + n, 0) if c < 0 else np.array([_key(_least(s, m).min()[None], c, f)[0] for f, m in enumerate(multipliers)], np.uint64)
                    out.append((i, hashlib.md5(text).digest(), c, s.tobytes(), keys.view(np.int64).tolist()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)

    return items.mapInArrow(run, "item_id long, text_key binary, size_class int, sets binary, keys array<long>")


class Filter:
    """A Bloom filter; a key's probes are disjoint or overlapping runs of its bits."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def of(keys: DataFrame, bits: int) -> Filter:
        """The filter of ``keys(key)``: one row of the result for each of its 64-bit words that is not zero."""
        spots = keys.select(F.explode(F.array(*(F.shiftrightunsigned(F.shiftleft("key", 13 * i), 64 - bits) for i in range(PROBES)))).alias("at"))
        words = spots.groupBy(F.shiftrightunsigned("at", 6).cast("int").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("word")).toArrow()
        out = np.zeros(1 << bits >> 6, np.int64)
        out[words["i"].to_numpy()] = words["word"].to_numpy()
        return Filter(out.view(np.uint64), bits)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Indexes of the keys that may have been put in."""
        at = np.arange(len(keys))
        for i in range(PROBES):
            spot = (keys[at] << np.uint64(13 * i)) >> np.uint64(64 - self.bits)
            at = at[(self.words[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) > 0]
        return at


def document_keys(h: np.ndarray, counts: np.ndarray, classes: list[int], multipliers: np.ndarray, sent: Filter) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of all blocks' keys that the filter holds; ``h``: the windows of documents of ``counts`` each."""
    levels, docs, before = [], np.arange(len(counts)), None
    for c in range(min(classes), max(classes) + 1):  # a block of one level is two of the level before
        blocks = -(-counts // (1 << c))
        width = 1 << c if before is None else 2
        have = counts if before is None else before
        first = np.cumsum(have) - have
        nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        levels.append((c, np.repeat(first, blocks) + nth * width, np.repeat(docs, blocks)))
        before = blocks
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for f, m in enumerate(multipliers):
        low = _least(h, m)
        for c, starts, owner in levels:
            low = np.minimum.reduceat(low, starts)
            if c in classes:
                keys = _key(low, c, f)
                if (hit := sent.holds(keys)).size:
                    found.append((owner[hit], keys[hit]))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.empty(0, np.int64), np.empty(0, np.uint64))


def _hits(rows: DataFrame, classes: list[int], runs: list[int], functions: int, sent_filter: Filter) -> DataFrame:
    """(row, doc_id, text_key, sets, keys) of the documents with keys in the filter: of blocks of the classes, and of
    runs of so many words; ``sets`` has the five-word windows and the runs with a key."""
    multipliers = _functions(functions)
    sent = rows.sparkSession.sparkContext.broadcast(sent_filter)
    fields = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.binary()), ("sets", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            texts = utf8(batch.column(1))
            words = [hashes.of(text.split()) for text in texts]
            windows = [window_hashes(h) for h in words]
            filled = [k for k, x in enumerate(windows) if len(x)]
            if not filled:
                continue
            owner, keys = document_keys(np.concatenate([windows[k] for k in filled]), np.array([len(windows[k]) for k in filled], np.int64), classes, multipliers, sent.value)
            for i, k in enumerate(filled):
                for n in runs:
                    if len(words[k]) >= n:
                        found = np.unique(window_hashes(words[k], n))
                        run_keys = _key(found, RUNS + n, 0)
                        if (hit := sent.value.holds(run_keys)).size:
                            owner, keys = np.append(owner, np.full(hit.size, i)), np.append(keys, run_keys[hit])
                            windows[k] = np.append(windows[k], found[hit])
            out = []
            if owner.size:
                doc_ids, row_ids = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                order = np.argsort(owner, kind="stable")
                owner, keys = owner[order], keys[order]
                ends = np.flatnonzero(np.append(owner[1:] != owner[:-1], True)) + 1
                for a, b in zip([0, *ends[:-1]], ends, strict=True):
                    k = filled[owner[a]]
                    out.append((row_ids[k], doc_ids[k], hashlib.md5(texts[k]).digest(), np.unique(windows[k]).tobytes(), np.unique(keys[a:b]).view(np.int64).tolist()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)

    return rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "row long, doc_id long, text_key binary, sets binary, keys array<long>")


def _verified(units: DataFrame, threshold: float) -> DataFrame:
    """Results for ``units(row, is_item, id, text_key, sets)``, sorted so: each document before its candidate items."""
    fields = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shared", pa.int64()), ("n_item", pa.int64()), ("containment", pa.float64()), ("text_key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_id, text_key, own = None, None, np.empty(0, np.uint64)
        for batch in slices(batches):
            out = []
            for is_item, i, key, sets in zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True):
                sets = np.frombuffer(sets, np.uint64)
                if not is_item:
                    doc_id, text_key, own = i, key, sets
                    continue
                at = np.minimum(np.searchsorted(own, sets), len(own) - 1)
                shared = int((own[at] == sets).sum())
                if shared >= threshold * len(sets) - 1e-9:
                    out.append((doc_id, i, shared, len(sets), shared / len(sets), text_key))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)

    return units.mapInArrow(run, "doc_id long, item_id long, n_shared long, n_item long, containment double, text_key binary")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = SIMILARITY, functions: int = FUNCTIONS, most_bits: int = MOST_BITS, least_run: int = 1) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment, text_key) for every item of which a document has the threshold.

    Shingles are five words; an item of fewer words is one shingle of all of them and is found wherever a document has
    these words in a row, or, if they are fewer than ``least_run``, only in a document of just these words (in longer
    ones a word or two say nothing of where they come from); an item or document without words has none. Null
    text is empty; null ids are returned as they are. A repeated document row gives its rows again (text_key, the
    digest of its text, tells rows of one id apart), equal items of different ids each give a row. No items or no
    documents: no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    small = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")).distinct()
    index = written(item_sets(small, functions, least_run))
    sizes = {r["size_class"]: r["n"] for r in index.groupBy("size_class").agg(F.count("*").alias("n")).collect()}
    keys = index.select("item_id", F.col("text_key").alias("item_key"), F.explode("keys").alias("key"))
    bits = min(most_bits, max(min(LEAST_BITS, most_bits), (64 * functions * sum(sizes.values())).bit_length()))
    classes, runs = sorted(c for c in sizes if c > 0), sorted(-c for c in sizes if c < 0)
    with small_batches(docs.sparkSession):
        found = written(_hits(rows, classes or [1], runs, functions, Filter.of(keys, bits)))
    pairs = found.select("row", F.explode("keys").alias("key")).join(keys, "key").select("row", "item_id", "item_key").distinct()
    sets = index.select(F.col("item_id").alias("id"), F.col("text_key").alias("item_key"), "sets")
    near = pairs.join(sets, F.col("item_id").eqNullSafe(F.col("id")) & (pairs["item_key"] == sets["item_key"])).select("row", F.lit(True).alias("is_item"), "id", pairs["item_key"].alias("text_key"), "sets")
    own = found.join(pairs.select("row").distinct(), "row", "left_semi").select("row", F.lit(False).alias("is_item"), F.col("doc_id").alias("id"), "text_key", "sets")
    return _verified(own.unionByName(near).repartition("row").sortWithinPartitions("row", "is_item"), threshold)


def op10_benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
