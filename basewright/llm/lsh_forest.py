"""N-gram Jaccard join by a MinHash LSH forest.

Every distinct text gets one label per tree, a sequence of LABEL_DEPTH MinHash values of its word shingles. A tree
sorted by its labels is a prefix trie, and two texts meet in it at the length of their labels' common prefix. A pair
belongs to the tree in which it meets deepest, the first of several, so it is verified once. Each region of a tree,
the labels below one shortest prefix, starts at full depth and shortens the matched prefix step by step: it stops once
the pairs found tell that the target recall is reached, namely when they are enough to rule out with 95 % confidence
that more than 1 - recall of all pairs are less similar than the least similar one found, and pairs as that one meet
at this depth with the target recall; else it goes on to the shortest prefix, at which a pair at the threshold t
meets with 1 - (1 - t^depth)^trees, the target. Pairs are verified exactly by their shingle sets.

Exact copies are one class from the start. A region whose texts all share a whole label in an earlier tree has no
pairs of its own and is left out. A region heavier than a block is split into blocks by hash, and every pair of
blocks is a unit of work of its own; within a unit, pairs are counted by matrix products and leave it as one row per
text (its links and a local root), never as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm.common import SIMILARITY, WordHashes, mix, shingles, slices, table, text_or_empty, utf8, written

TREES = 12
LABEL_DEPTH = 8
RECALL = 0.998
#: Bytes of text in one block of a heavy group.
BLOCK_BYTES = 2 << 20
#: What a text counts at least, so that a block has at most some 1,000 texts.
LEAST_WEIGHT = 2048


def meeting(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that a pair's labels share a prefix of ``depth`` in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(threshold: float = SIMILARITY, trees: int = TREES, label_depth: int = LABEL_DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target recall."""
    depth = label_depth
    while depth > 1 and meeting(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20_240_501).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tree_labels(sets: np.ndarray, multipliers: np.ndarray, trees: int, shortest: int) -> np.ndarray:
    """[trees, depths]: each label's prefixes of ``shortest`` and more values, each folded to 64 bits."""
    lowest = None
    for i in range(0, len(sets), 256):
        x = np.multiply.outer(multipliers, sets[i : i + 256])
        x ^= x >> np.uint64(29)
        low = x.min(1)
        lowest = low if lowest is None else np.minimum(lowest, low)
    values = mix(lowest).reshape(trees, -1)
    fold, out = values[:, 0].copy(), []
    for i in range(1, values.shape[1] + 1):
        if i >= shortest:
            out.append(fold)
        if i < values.shape[1]:
            fold = mix(fold * np.uint64(3) + values[:, i])
    return np.stack(out, 1)


def forest(texts: DataFrame, trees: int, shortest: int, label_depth: int = LABEL_DEPTH) -> DataFrame:
    """(key, weight, labels): the labels of each text with at least one word, as uint64 bytes."""
    fields = pa.schema([("key", pa.binary()), ("weight", pa.int64()), ("labels", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, multipliers = WordHashes(), _multipliers(trees * label_depth)
        for batch in slices(batches):
            keys, weights, labels = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                sets = shingles(text, hashes)
                if len(sets):
                    keys.append(key)
                    weights.append(max(len(text), LEAST_WEIGHT))
                    labels.append(tree_labels(sets, multipliers, trees, shortest).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(weights, pa.int64()), pa.array(labels, pa.binary())], schema=fields)

    return texts.select("key", "text").mapInArrow(run, "key binary, weight long, labels binary")


def similarities(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """|x & y| / |x | y| for every x of ``a`` and y of ``b`` (``a`` if none)."""
    every = a if b is None else a + b
    sizes = np.array([len(x) for x in every])
    flat, row = np.concatenate(every), np.repeat(np.arange(len(every)), sizes)
    _, where, times = np.unique(flat, return_inverse=True, return_counts=True)
    kept = times[where] > 1  # a shingle of one text is in no intersection
    names, where = np.unique(where[kept], return_inverse=True)
    row = row[kept]
    order = np.argsort(where, kind="stable")
    where, row = where[order], row[order]
    n = len(a)
    common = np.zeros((n, n if b is None else len(b)), np.float32)
    step = max(64, (8 << 20) // max(1, len(every)))  # columns at a time: 32 MB of incidence
    for i in range(0, len(names), step):
        lo, hi = np.searchsorted(where, [i, i + step])
        part = np.zeros((len(every), min(step, len(names) - i)), np.float32)
        part[row[lo:hi], where[lo:hi] - i] = 1
        common += part[:n] @ (part if b is None else part[n:]).T
    together = sizes[:n, None].astype(np.float32) + (sizes if b is None else sizes[n:])[None, :] - common
    return common / together


def meeting_levels(a: np.ndarray, b: np.ndarray, tree: int) -> np.ndarray:
    """[len(a), len(b)]: how many of the prefixes of labels ``a`` and ``b`` [texts, trees, prefixes] agree in ``tree``,
    0 for pairs that belong to another tree."""
    own = None
    deepest = np.zeros((len(a), len(b)), np.int8)
    for t in [tree, *(u for u in range(a.shape[1]) if u != tree)]:
        level = np.zeros_like(deepest)
        for j in range(a.shape[2]):
            same = a[:, t, j][:, None] == b[:, t, j][None, :]
            if not same.any():
                break
            level += same
        if own is None:
            own = level
        else:
            own[(level >= own) if t < tree else (level > own)] = 0
    return own


def _roots(linked: np.ndarray, crossed: bool) -> tuple[np.ndarray, np.ndarray]:
    """The least index of the component of each row and column; columns count on after rows if ``crossed``."""
    rows, none = np.arange(linked.shape[0], dtype=np.int32), np.int32(np.iinfo(np.int32).max)
    columns = rows if not crossed else np.arange(linked.shape[0], sum(linked.shape), dtype=np.int32)
    while True:
        new = np.minimum(rows, np.where(linked, columns[None, :], none).min(1, initial=none))
        new_columns = new if not crossed else np.minimum(columns, np.where(linked, new[:, None], none).min(0, initial=none))
        if (new == rows).all() and (new_columns == columns).all():
            return rows, columns
        rows, columns = new, new_columns


def verify(units: DataFrame, trees: int, threshold: float, shortest: int, recall: float = RECALL) -> DataFrame:
    """(key, links, root) of the texts with a link, for each unit of ``units`` (sorted by its first four columns).

    units: tree, prefix, low, high, block, key, labels, text.
    """
    fields = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])

    def unit(tree: int, crossed: bool, rows: list[tuple]) -> pa.RecordBatch | None:
        rows = list({(r[0], r[1]): r for r in rows}.values())  # equal rows of the input
        rows.sort(key=lambda r: r[:2])
        labels = np.frombuffer(b"".join(r[2] for r in rows), np.uint64).reshape(len(rows), trees, -1)
        cut = sum(r[0] == rows[0][0] for r in rows) if crossed else 0
        level = meeting_levels(labels[:cut] if crossed else labels, labels[cut:], tree)
        if not crossed:
            np.fill_diagonal(level, 0)
        hashes, sets = WordHashes(), {}
        linked = np.zeros(level.shape, bool)
        found, least = 0, 1.0
        for now in range(labels.shape[2], 0, -1):  # shorten the matched prefix
            todo = level == now
            i, j = np.flatnonzero(todo.any(1)), np.flatnonzero(todo.any(0))
            if not i.size:
                continue
            for k in (*i, *(j + cut)):
                if k not in sets:
                    sets[k] = shingles(rows[k][3], hashes)
            like = similarities([sets[k] for k in i], [sets[k + cut] for k in j] if crossed else None)
            near = (like >= threshold - 1e-6) & todo[np.ix_(i, j)]
            linked[np.ix_(i, j)] |= near
            if near.any():
                found, least = found + int(near.sum()) // (1 if crossed else 2), min(least, float(like[near].min()))
            if found * (1 - recall) >= 3 and meeting(least, shortest + now - 1, trees) >= recall:
                break
        if not linked.any():
            return None
        root, column_root = _roots(linked, crossed)
        parts = [(linked.sum(1), root, 0)] + ([(linked.sum(0), column_root, cut)] if crossed else [])
        some = [(k + at, n[k], r[k]) for n, r, at in parts for k in np.flatnonzero(n)]
        return pa.RecordBatch.from_arrays([pa.array([rows[k][1] for k, _, _ in some], pa.binary()), pa.array([n for _, n, _ in some], pa.int64()), pa.array([rows[r][1] for _, _, r in some], pa.binary())], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in slices(batches):
            columns = [batch.column(i).to_pylist() for i in range(7)] + [utf8(batch.column(7))]
            for *now, block, key, labels, text in zip(*columns, strict=True):
                if now != at:
                    if len(rows) > 1 and (out := unit(at[0], at[2] != at[3], rows)) is not None:
                        yield out
                    at, rows = now, []
                rows.append((block, key, labels, text))
        if len(rows) > 1 and (out := unit(at[0], at[2] != at[3], rows)) is not None:
            yield out

    return units.mapInArrow(run, "key binary, links long, root binary")


def components(edges: DataFrame) -> DataFrame:
    """(key, root) with the least key of each connected component, for ``edges(key, root)``.

    Alternates large-star and small-star steps until nothing changes; each round is written to the shared
    folder. A vertex's neighbours are only aggregated (least) and joined, never gathered.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("key").alias("u"), F.col("root").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("root").alias("u"), F.col("key").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("key"), F.col("m").alias("root"))
        else:
            out = joined.select(F.col("v").alias("key"), F.col("m").alias("root")).unionByName(least.select(F.col("u").alias("key"), F.col("m").alias("root")))
        return out.where("key != root").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.hash("key", "root").cast("long"))).first())

    e = written(edges.select(F.greatest("key", "root").alias("key"), F.least("key", "root").alias("root")).where("key != root").distinct())
    before = mark(e)
    while before[0]:
        e = written(star(star(e, True), False))
        now = mark(e)
        if now == before:
            break
        before = now
    return e


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, trees: int = TREES, recall: float = RECALL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: its class and its links.

    doc_id; copy_id: the least doc_id with the same text; class_id: the least doc_id of the texts joined to it by
    links, over any number of steps (class_key: that text's digest); n_copies: rows with its text, itself included; n_links: the other distinct
    texts whose 5-word shingle sets reach the threshold; key: the text's digest. Null text is empty. A text of
    fewer than five words is one shingle; an empty one has no links, but equal rows share a class. Null ids are
    returned and never chosen as class_id unless a class has no other. An empty table gives no rows.
    """
    shortest = prefix_depth(threshold, trees, recall=recall)
    width = 8 * (LABEL_DEPTH - shortest + 1)  # bytes of a tree's label
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("key", F.unhex(F.md5("text")))
    classes = written(rows.groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("n_copies")))
    labels = written(forest(rows, trees, shortest).dropDuplicates(["key"]))

    prefix = F.expr(f"transform(sequence(0, {trees - 1}), t -> struct(t AS tree, substring(labels, {width} * t + 1, 8) AS prefix))")
    spots = labels.select("key", "weight", F.explode(prefix).alias("s")).select("key", "weight", "s.tree", "s.prefix")
    regions = spots.groupBy("tree", "prefix").agg(F.count("*").alias("n"), F.sum("weight").alias("bytes")).where("n > 1")
    met = written(spots.join(regions, ["tree", "prefix"]).join(labels.select("key", "labels"), "key"))
    whole = [F.substring("labels", width * (t + 1) - 7, 8) for t in range(trees)]
    regions = met.groupBy("tree", "prefix").agg(F.first("bytes").alias("bytes"), *((F.min(x) == F.max(x)).alias(f"same{t}") for t, x in enumerate(whole)))
    own = regions.where(~F.exists(F.array(*(F.col(f"same{t}") & (F.col("tree") > t) for t in range(trees))), lambda x: x))
    own = own.select("tree", "prefix", F.ceil(F.col("bytes") / block_bytes).cast("int").alias("blocks"))
    spots = met.select("key", "labels", "tree", "prefix").join(own, ["tree", "prefix"]).groupBy("key").agg(F.first("labels").alias("labels"), F.collect_list(F.struct("tree", "prefix", "blocks")).alias("spots"))  # one a tree
    spots = written(spots.join(classes.select("key", "copy_id"), "key"))

    spots = spots.withColumn("id", F.coalesce("copy_id", F.lit(0)))  # of a text's copies, the row it is known by
    ids = rows.select("key", "text", F.coalesce("doc_id", F.lit(0)).alias("id"))
    units = ids.join(spots, ["key", "id"]).dropDuplicates(["key", "id"]).select("key", "text", "labels", F.explode("spots").alias("s"))
    units = units.select("key", "text", "labels", "s.*").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("tree", "prefix", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key", "labels", "text")
    unit = ["tree", "prefix", "low", "high"]
    links = written(verify(units.repartition(*unit).sortWithinPartitions(*unit), trees, threshold, shortest, recall))

    roots = components(links.select("key", "root"))
    linked = links.groupBy("key").agg(F.sum("links").alias("n_links"))
    classes = classes.join(linked, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = classes.groupBy("root").agg(F.min(F.struct(F.col("copy_id").isNull().alias("no"), "copy_id", "key")).alias("l"))
    least = least.select("root", F.col("l.copy_id").alias("class_id"), F.col("l.key").alias("class_key"))
    classes = classes.join(least, "root").drop("root").fillna(0, ["n_links"])
    return rows.select("doc_id", "key").join(classes, "key").select("doc_id", "copy_id", "class_id", "n_copies", "n_links", "key", "class_key")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("key", "class_key")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of its class_id (rows that repeat its id and text fall to one).

    Null text is empty, and all empty texts are one class. A class whose ids are all null keeps one row. All columns
    pass, whatever their names. An empty table stays empty.
    """
    classes = near_duplicates(docs.select("doc_id", "text"))
    best = classes.where("key = class_key AND doc_id <=> class_id").select("key", F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("row"), F.unhex(F.md5(text_or_empty())).alias("text_key"), F.col("doc_id").cast("long").alias("row_id"))
    kept = rows.join(best, (F.col("text_key") == F.col("key")) & F.col("row_id").eqNullSafe(F.col("id")))
    return kept.dropDuplicates(["key", "id"]).select("row.*")
