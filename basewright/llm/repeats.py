"""Removal of passages that stand in an earlier document, by anchors at fixed blocks.

Every document is cut into blocks of half a window of words, one after the other: the index. Any window of any document
holds one of its blocks whole, at one of the first offsets, so a window that two documents share makes the block's hash
turn up as a rolling block of both. Three steps, none of which pairs documents:

1. Blocks and rolling blocks are sent to shards by hash. A shard keeps the index with the least document of each block
   and runs the rolling blocks past it; what it returns are the hashes of blocks found in a later document: the anchors.
2. Anchors go into a Bloom filter of bounded size. Every task finds the anchors in its texts and extends each: it takes
   the windows that have it as their first anchor. As equal windows have equal first anchors, they meet in the anchor's
   shard, in order of documents, where a window (by 96 bits of hash and its anchor's shard) is a repeat if an earlier
   document had it. Adjacent ones make maximal exact repeats. What the filter lets through in error costs time only.
3. Repeats, as spans, are joined to the texts.

What travels is packed: one row for a task's chunk of texts and shard, or for a run of windows. Within a chunk equal
blocks are sent once and only the least document's windows are, so a passage that very many documents share is sent
once a chunk. Shards read their index first, or their windows by document, and stream the rest: a frequent passage needs
time in its shard, no memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import WordHashes, mix, slices, table, text_or_empty, utf8, written
from basewright.llm.containment import Filter

WINDOW = 50
#: Words of one chunk, but for a longer document.
CHUNK_WORDS = 3 << 18
#: Bits of the anchors' filter as powers of two: 64 an anchor, within these; a full filter costs speed, not results.
LEAST_BITS, MOST_BITS = 16, 28
#: Shards for each shuffle partition.
SHARDS = 4
_BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F & ~2 | 5)
#: Order of documents without an id: after all others.
LAST = (1 << 63) - 1


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full((1 << bits) - 1, base, np.uint64)]))


def rolling(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """64-bit hashes of all n-word windows of ``h``, by differences of prefix sums."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    base, bits = _BASES[which], len(h).bit_length()
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers(base, bits)[: len(h)], dtype=np.uint64)])
    return mix((sums[n:] - sums[:-n]) * _powers(pow(base, -1, 1 << 64), bits)[: len(h) - n + 1])


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _anchor_keys(keys: np.ndarray, shards: int) -> np.ndarray:
    """What is left of block hashes in a shard, and the shard, spread over 64 bits."""
    return mix(_shard(keys, shards) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF))


class Chunk:
    """Texts of some documents as word hashes, in order of ids; rows that repeat id and text are taken once."""

    def __init__(self, rows: list[tuple[int, int, np.ndarray]]):
        rows.sort(key=lambda r: r[:2])
        rows = [r for k, r in enumerate(rows) if not k or r[:2] != rows[k - 1][:2]]
        self.order, self.text_key = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
        sizes = np.array([len(r[2]) for r in rows], np.int64)
        self.words = np.concatenate([r[2] for r in rows])
        self.owner = np.repeat(np.arange(len(rows)), sizes)
        self.place = np.arange(len(self.words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.room = sizes[self.owner] - self.place

    def windows(self, n: int) -> np.ndarray:
        """Where windows of n words start."""
        return np.flatnonzero(self.room >= n)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Of rows of order, text_key, text."""
    hashes, rows, n = WordHashes(), [], 0
    for batch in slices(batches):
        for order, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
            if words := text.split():
                rows.append((order, key, hashes.of(words)))
                n += len(words)
                if n >= CHUNK_WORDS:
                    yield Chunk(rows)
                    rows, n = [], 0
    if rows:
        yield Chunk(rows)


def _runs(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last indexes of runs; ``edges``: whether an element starts one."""
    first = np.flatnonzero(edges)
    return first, np.append(first, len(edges))[1:] - 1


def _packed(flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """Runs of an array, one after the other, as binary values."""
    offsets = np.append(first, last[-1] + 1 if len(last) else 0).astype(np.int64) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind), np.array([len(v) for v in values], np.int64) // np.dtype(kind).itemsize


def _sent_blocks(rows: DataFrame, block: int, shards: int) -> DataFrame:
    """(shard, rolling, docs, counts, keys): per chunk and shard the 32-bit rests of distinct block hashes, so many of
    each document: of the index with the least document that has each, of rolling blocks with the greatest."""
    names = ["shard", "rolling", "docs", "counts", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            keys, every = rolling(chunk.words, block), chunk.windows(block)
            for is_rolling, at in ((0, every[chunk.place[every] % block == 0]), (1, every)):
                if not len(at):
                    continue
                at = at[np.argsort(keys[at], kind="stable")]  # equal ones stay in order of documents
                differ = keys[at[1:]] != keys[at[:-1]]
                at = np.sort(at[np.append(differ, True) if is_rolling else np.append(True, differ)])
                shard = _shard(keys[at], shards)
                by = np.argsort(shard, kind="stable")
                at, shard, owner = at[by], shard[by], chunk.owner[at[by]]
                doc, doc_end = _runs(np.append(True, (owner[1:] != owner[:-1]) | (shard[1:] != shard[:-1])))
                first, last = _runs(np.append(True, shard[doc[1:]] != shard[doc[:-1]]))
                rest = (keys[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                columns = [pa.array(shard[doc[first]].astype(np.int32)), pa.array(np.full(len(first), is_rolling, np.int32))]
                columns += [_packed(chunk.order[owner[doc]], first, last), _packed((doc_end - doc + 1).astype(np.int32), first, last), _packed(rest, doc[first], doc_end[last])]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, "shard int, rolling int, docs binary, counts binary, keys binary")


def _anchors(sent: DataFrame) -> DataFrame:
    """(key): blocks of the index that a later document has as well, of ``sent`` sorted by shard, the index first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, pieces, index, found = None, [], None, np.empty(0, bool)

        def keys() -> pa.RecordBatch:
            some = index[0][found].astype(np.uint64) | np.uint64(shard) << np.uint64(32)
            return pa.RecordBatch.from_arrays([pa.array(mix(some).view(np.int64))], ["key"])

        for batch in slices(batches):
            for s, is_rolling, docs, counts, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs, rest = np.repeat(np.frombuffer(docs, np.int64), np.frombuffer(counts, np.int32)), np.frombuffer(rest, np.uint32)
                if s != shard:
                    if found.any():
                        yield keys()
                    shard, pieces, index, found = s, [], None, np.empty(0, bool)
                if not is_rolling:
                    pieces.append((rest, docs))
                    continue
                if index is None:
                    k, d = (np.concatenate([p[i] for p in pieces] or [np.empty(0, t)]) for i, t in ((0, np.uint32), (1, np.int64)))
                    by = np.lexsort((d, k))
                    k, d = k[by], d[by]
                    new = np.append(True, k[1:] != k[:-1])[: len(k)]
                    index, pieces = (k[new], d[new]), []
                    found = np.zeros(len(index[0]), bool)
                if len(found):
                    at = np.minimum(np.searchsorted(index[0], rest), len(found) - 1)
                    found[at[(index[0][at] == rest) & (docs > index[1][at])]] = True
        if found.any():
            yield keys()

    return sent.mapInArrow(run, "key long")


def _sent_windows(rows: DataFrame, anchors: Filter, window: int, block: int, shards: int) -> DataFrame:
    """(shard, order, text_key, start, stop, keys, more): runs of windows that have the same first anchor, with 64 and
    32 bits of hash of each, from word ``start`` on; and, without hashes, spans known to be repeats as an earlier
    document of the chunk has them."""
    sent = rows.sparkSession.sparkContext.broadcast(anchors)
    names = ["shard", "order", "text_key", "start", "stop", "keys", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            blocks, every = rolling(chunk.words, block), chunk.windows(block)
            anchored = _anchor_keys(blocks[every], shards)
            hits = every[np.sort(sent.value.holds(anchored))]
            if not len(hits):
                continue
            at = chunk.windows(window)
            next_hit = np.append(hits, LAST)[np.searchsorted(hits, at)]
            held = next_hit - at < block
            at, anchor = at[held], next_hit[held]
            if not len(at):
                continue
            keys = rolling(chunk.words, window)[at]
            more = (rolling(mix(chunk.words ^ np.uint64(_BASES[1])), window, 1)[at] >> np.uint64(32)).astype(np.uint32)
            order = chunk.order[chunk.owner[at]]
            by = np.argsort(keys, kind="stable")
            new = np.append(True, (keys[by[1:]] != keys[by[:-1]]) | (more[by[1:]] != more[by[:-1]]))
            least = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
            known = np.zeros(len(at), bool)
            known[by] = order[by] > order[least]
            for some, hashes in ((np.flatnonzero(~known), True), (np.flatnonzero(known), False)):
                if not len(some):
                    continue
                edge = np.append(True, np.diff(at[some]) != 1)
                if hashes:
                    edge |= np.append(True, np.diff(anchor[some]) != 0)
                first, last = _runs(edge)
                head, tail = some[first], some[last]
                owner = chunk.owner[at[head]]
                columns = [pa.array(_shard(_anchor_keys(blocks[anchor[head]], shards), shards).astype(np.int32)), pa.array(chunk.order[owner]), pa.array(chunk.text_key[owner])]
                columns += [pa.array(chunk.place[at[head]].astype(np.int32)), pa.array((chunk.place[at[tail]] + window).astype(np.int32))]
                if hashes:
                    columns += [_packed(keys[some], first, last), _packed(more[some], first, last)]
                else:
                    columns += [pa.array([b""] * len(first), pa.binary())] * 2
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, "shard int, order long, text_key long, start int, stop int, keys binary, more binary")


def _spans(sent: DataFrame, window: int) -> DataFrame:
    """(order, text_key, start, stop): words that windows cover which an earlier document has, of ``sent`` sorted by
    shard and order."""
    names = ["order", "text_key", "start", "stop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen = None, ()
        for batch in batches:
            shards, orders, _, starts, _ = (batch.column(i).to_numpy() for i in range(5))
            (keys, sizes), (more, _) = _unpacked(batch.column(5), np.uint64), _unpacked(batch.column(6), np.uint32)
            ends = np.cumsum(sizes)
            row = np.repeat(np.arange(batch.num_rows), sizes)
            place = starts[row] + np.arange(len(row)) - np.repeat(ends - sizes, sizes)
            repeat = np.zeros(len(row), bool)
            for i, j in zip(*_runs(np.append(True, shards[1:] != shards[:-1])), strict=True):
                if shards[i] != shard:
                    shard, seen = shards[i], (np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.int64))
                part = slice(ends[i] - sizes[i], ends[j])
                if part.start == part.stop:
                    continue
                k, x, o = keys[part], more[part], orders[row[part]]
                by = np.argsort(k, kind="stable")  # equal ones stay in order of documents
                k, x, o = k[by], x[by], o[by]
                new = np.append(True, (k[1:] != k[:-1]) | (x[1:] != x[:-1]))
                group, least = np.cumsum(new) - 1, o[new]
                fresh = np.ones(len(least), bool)
                if len(seen[0]):
                    at = np.minimum(np.searchsorted(seen[0], k[new]), len(seen[0]) - 1)
                    fresh = (seen[0][at] != k[new]) | (seen[1][at] != x[new])
                    least = np.where(fresh, least, seen[2][at])
                repeat[part][by] = o > least[group]
                seen = tuple(np.concatenate([a, b[fresh]]) for a, b in zip(seen, (k[new], x[new], least), strict=True))
                by = np.argsort(seen[0], kind="stable")
                seen = tuple(a[by] for a in seen)
            some = np.flatnonzero(repeat)
            first, last = _runs(np.append(True, (np.diff(row[some]) != 0) | (np.diff(place[some]) != 1))[: len(some)])
            known = np.flatnonzero(sizes == 0)
            rows = pa.array(np.concatenate([row[some[first]], known]))
            start, stop = place[some[first]], place[some[last]] + window
            columns = [batch.column(1).take(rows), batch.column(2).take(rows), pa.array(np.concatenate([start, starts[known]]).astype(np.int32))]
            columns.append(pa.array(np.concatenate([stop, batch.column(4).to_numpy()[known]]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(columns, names)

    return sent.mapInArrow(run, "order long, text_key long, start int, stop int")


def _order(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(LAST))


def repeated_spans(docs: DataFrame, window: int = WINDOW, most_bits: int = MOST_BITS) -> DataFrame:
    """(order, text_key, start, stop): spans of words, from 0, stop excluded, that windows of ``window`` words cover
    which also stand in a document of a lesser id. order: the id, null as the greatest of all; text_key: xxhash64 of
    the text. Spans of one document may overlap; their union is what repeats. Rows alike in id and text give theirs
    once; rows of one id with different texts are not earlier or later than each other."""
    if window < 2:
        raise ValueError("a window has two words at least")
    spark, block = docs.sparkSession, (window + 1) // 2
    shards = SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(_order(F.col("doc_id")).alias("order"), F.xxhash64(text_or_empty()).alias("text_key"), text_or_empty().alias("text"))
    sent = _sent_blocks(rows, block, shards).repartition("shard").sortWithinPartitions("shard", "rolling")
    anchors = written(_anchors(sent))
    bits = min(most_bits, max(LEAST_BITS, (64 * anchors.count()).bit_length()))
    runs = _sent_windows(rows, Filter.of(anchors, bits), window, block, shards)
    return _spans(runs.repartition("shard").sortWithinPartitions("shard", "order"), window)


def remove_repeats(docs: DataFrame, window: int = WINDOW, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans): of each row of ``docs`` the words of ``text`` that no repeated window
    covers, joined by one space, and the maximal spans of words that go (array<struct<start, stop>>, from 0).

    A window is repeated if it stands in a document with a lesser id; all are judged on the input. Null text has no
    words. A null id counts as greater than all others, so such rows lose what any row with an id has, and are not
    held against each other. Rows that repeat id and text are treated alike; rows of one id with different texts each
    by itself. Texts of fewer words than a window stay whole. Other columns are ignored; no rows give no rows.
    """
    spans = repeated_spans(docs, window, most_bits).distinct()
    spans = spans.groupBy("order", "text_key").agg(F.collect_list(F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("stop"))).alias("found"))  # of one text
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _order(F.col("doc_id")).alias("order"), F.xxhash64(text_or_empty()).alias("text_key"), text_or_empty().alias("text"))
    joined = rows.join(spans.hint("shuffle_hash"), ["order", "text_key"], "left").select("doc_id", "text", "found")
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    fields = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, gone, kept, spans = [], [], [], []
            for text, found in zip(utf8(batch.column(1)), batch.column(2), strict=True):
                words, cut = text.split(), []
                if found.is_valid:
                    both = np.sort(found.values.to_numpy(zero_copy_only=False))
                    edges = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edges, both >> 32, 1)
                    np.add.at(edges, both & 0xFFFFFFFF, -1)
                    out = np.cumsum(edges[:-1]) > 0
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]])))
                    cut = [{"start": a, "stop": b} for a, b in turns.reshape(-1, 2).tolist()]
                    kept.append(b" ".join(compress(words, ~out)))
                else:
                    kept.append(b" ".join(words))
                sizes.append(len(words))
                gone.append(sum(s["stop"] - s["start"] for s in cut))
                spans.append(cut)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, gone)), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(columns, schema=fields)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,stop:int>>")


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  win AS (SELECT r, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS k FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
  rep AS (SELECT r, i FROM (SELECT r, i, coalesce(doc_id, 9223372036854775807) AS o, min(coalesce(doc_id, 9223372036854775807)) OVER (PARTITION BY k) AS least FROM win) WHERE o > least),
  words AS (SELECT r, i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
  marked AS (SELECT r, i, word, coalesce(i - max(rep.i) OVER (PARTITION BY r ORDER BY i) < 50, false) AS gone FROM words LEFT JOIN rep USING (r, i)),
  sums AS (SELECT r, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY 1)
  SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN sums USING (r)"""
