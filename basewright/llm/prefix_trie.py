"""The prefix trie of conversations: which first turns they share, and what a cache of prefixes would save.

Turns are numbered in a range-sorted table, so that a long conversation is many tasks, and encoded by a dictionary of
distinct (role, text). A conversation is a row of ids for each segment of a bounded number of turns. Sequences are cut
into range shards, ties by conversation, so that many equal conversations are many shards as well. Each shard puts its
distinct sequences into a ternary search tree, the median first, and goes through it without recursion: every node gets
its members, children, leaves and savings.

A node inside a shard is done with that. Nodes on the path of a shard's first or last sequence may go on in others:
they leave as partial sums, are merged by their prefix, and get their subtrees' sums along the paths: each merged node
is owned by the first path it lies on, and what a path owns below a node, summed over the node's paths, is what its
subtree holds. Segments after the first are tries below the node at which the segment before ends; they go first, and
hand that node what lies below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basewright.llm.common import table, written

#: Turns in one segment of a conversation.
SEGMENT = 4096
#: Turns and sequences in one range shard, on average.
SHARD_TURNS = 200_000
#: Parts of the dictionary join's frequent turns.
SALTS = 16
#: A conversation takes over turns of the least of each group of so many ids, up to MOST_SHARED - 1.
GROUP, MOST_SHARED = 5, 9
_EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, key, size): a conversation's turns numbered from 1, by turn (null first), then role and text; the
    turn's digest and its text's UTF-8 bytes. Null role or text is empty; rows without conv_id are left out; rows that
    repeat are turns of their own. Written to the shared folder."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = ("conv_id", F.asc_nulls_first("turn"), "role", "text")
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", key.alias("key"), F.octet_length("text").cast("long").alias("size"))
    placed = written(placed.withColumns({"_part": F.spark_partition_id(), "_line": F.monotonically_increasing_id()}))
    parts = placed.groupBy("conv_id", "_part").agg(F.min("_line").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("conv_id", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))  # a row a conversation and partition
    return written(placed.join(parts, ["conv_id", "_part"]).select("conv_id", (F.col("_line") + F.col("_shift")).alias("at"), "key", "size"))


def rebuild(turns: DataFrame, group: int = GROUP, most_shared: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """``turns`` (of numbered_turns) of conversations that take over the first h turns of another, and their lengths
    (conv_id, n). c gets those of c - c % group, as many as there are, and then its own after its first h; h is crc32
    of its decimal id modulo ``most_shared``. Ids below 0 have remainders from 0 on."""
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_shared
    convs = turns.groupBy("conv_id").agg(F.max("at").alias("own")).withColumns({"base": F.col("conv_id") - F.pmod("conv_id", F.lit(group)), "h": shared})
    bases = convs.where("conv_id = base").select("base", F.col("own").alias("have"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least(F.coalesce("have", F.lit(0)), F.col("h")))
    is_base = F.col("conv_id") == F.col("base")
    n = F.when(is_base, F.col("own")).otherwise(F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv_id", "base", "h", "taken", n.alias("n")))
    at_base = F.pmod("conv_id", F.lit(group)) == 0
    firsts = turns.where(at_base & (F.col("at") < most_shared)).withColumnRenamed("conv_id", "base")
    borrowed = firsts.join(convs.where("conv_id != base").select("conv_id", "base", "h"), "base").where("at <= h").select("conv_id", F.col("at").alias("depth"), "key", "size")
    base_rows = turns.where(at_base).select("conv_id", F.col("at").alias("depth"), "key", "size")
    # a conversation's row is needed by all its turns: salted, as one may have very many
    salted = convs.where("conv_id != base").select("conv_id", "h", "taken", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    own = turns.where(~at_base).withColumn("_salt", F.pmod("at", F.lit(SALTS)).cast("int")).join(salted, ["conv_id", "_salt"]).where("at > h")
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "key", "size")
    return base_rows.unionByName(borrowed).unionByName(own), convs.select("conv_id", "n")


def _encoded(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, id, size): digests by their numbers in a dictionary."""
    words = written(turns.groupBy("key").agg(F.max("size").alias("size")).withColumn("id", F.monotonically_increasing_id()))
    salted = words.select("key", "id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = turns.withColumn("_salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, ["key", "_salt"]).select("conv_id", "depth", "id", "size")


def _segments(turns: DataFrame, lengths: DataFrame, most: int) -> DataFrame:
    """(conv_id, layer, ids, sizes, root, below, ends): segments of ``most`` turns, the last of them shorter or empty;
    root and below tell the prefixes before and after a segment, below null if it is not full; ends: whether the
    conversation has no turns after it."""
    layer = F.floor((F.col("depth") - 1) / most).cast("int")
    rows = turns.groupBy("conv_id", layer.alias("layer")).agg(F.sort_array(F.collect_list(F.struct("depth", "id", "size"))).alias("t"))  # at most a segment
    rows = rows.select("conv_id", "layer", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))
    none = F.array().cast("array<long>")
    ended = lengths.where(F.col("n") % most == 0).select("conv_id", F.floor(F.col("n") / most).cast("int").alias("layer"), none.alias("ids"), none.alias("sizes"))
    over = Window.partitionBy("conv_id").orderBy("layer")
    digest = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "layer", "ids")).over(over.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.unionByName(ended).withColumn("_upto", F.concat_ws(":", digest(1), digest(2)))
    rows = rows.withColumn("root", F.coalesce(F.lag("_upto").over(over), F.lit("")))
    ends = (F.size("ids") < most) | (F.lead(F.size("ids")).over(over) == 0)
    return rows.select("conv_id", "layer", "ids", "sizes", "root", F.when(F.size("ids") == most, F.col("_upto")).alias("below"), ends.alias("ends"))


class Tree:
    """A ternary search tree of sequences; its middle links make the trie of their prefixes."""

    def __init__(self):
        self.value, self.less, self.more, self.down = [], [], [], []
        self.size, self.members, self.least, self.ends, self.extra = [], [], [], [], []

    def _node(self, value, size: int) -> int:
        for column, x in zip((self.value, self.less, self.more, self.down, self.size, self.members, self.least, self.ends, self.extra), (value, -1, -1, -1, size, 0, None, None, (0, 0, 0)), strict=True):
            column.append(x)
        return len(self.value) - 1

    def insert(self, values: list, sizes: list[int], convs: list[int], ends: list[int], extra: tuple[int, int, int]) -> list[int]:
        """The nodes of a sequence that ``convs`` (ascending) have, of which ``ends`` end with it; extra: what is below."""
        path, at, link, owner = [], 0 if self.value else -1, None, -1
        for value, size in zip(values, sizes, strict=True):
            while at >= 0 and self.value[at] != value:
                link, owner = (self.less, at) if value < self.value[at] else (self.more, at)
                at = link[at]
            if at < 0:
                at = self._node(value, size)
                if link is not None:
                    link[owner] = at
            self.members[at] += len(convs)
            self.least[at] = convs[0] if self.least[at] is None else min(self.least[at], convs[0])
            path.append(at)
            link, owner, at = self.down, at, self.down[at]
        self.ends[path[-1]], self.extra[path[-1]] = ends, extra
        return path

    def walk(self) -> Iterator[tuple[int, int, int]]:
        """(node, parent, level), parents before children."""
        todo = [(0, -1, 0)] if self.value else []
        while todo:
            node, parent, level = todo.pop()
            yield node, parent, level
            todo += [(x, parent, level) for x in (self.less[node], self.more[node]) if x >= 0]
            if self.down[node] >= 0:
                todo.append((self.down[node], node, level + 1))


def medians(n: int) -> Iterator[int]:
    """0 .. n - 1, each range's middle before its halves."""
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            todo += [(mid + 1, hi), (lo, mid)]


_NODES = "path int, level int, key binary, parent_key binary, root string, conv_id long, parent_conv_id long, parent_path int, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, below_children long, below_leaves long, below_saved long, ends binary, ends_sha256 string"


def _decimals(convs: list[int]) -> bytes:
    return ",".join(map(str, convs)).encode()


def _shard_nodes(rows: list[tuple], shard: int) -> Iterator[tuple]:
    """Rows as _NODES of one shard's (root, ids, sizes, conv_id, ends, below_children, below_leaves, below_saved) in
    order: of done nodes with a null path, of those on the paths of its first (2 * shard) and last sequence."""
    distinct: list[tuple[list, list, list, list, tuple]] = []
    for root, ids, sizes, conv, ends, *extra in rows:
        values = [root, *ids]
        if not distinct or distinct[-1][0] != values:
            distinct.append((values, [0, *sizes], [], [], tuple(extra)))
        distinct[-1][2].append(conv)
        if ends:
            distinct[-1][3].append(conv)
    tree, edges = Tree(), {}
    for i in medians(len(distinct)):
        path = tree.insert(*distinct[i])
        for side, edge in enumerate((0, len(distinct) - 1)):
            if i == edge:
                edges[side] = path
    order = list(tree.walk())
    parents, levels = {n: p for n, p, _ in order}, {n: x for n, _, x in order}
    open_ = {n: side for side in (1, 0) for n in edges[side]}
    children, leaves, saved = ([0] * len(order) for _ in range(3))
    for n, parent, level in reversed(order):
        if n in open_:
            continue
        below_children, below_leaves, below_saved = tree.extra[n]
        children[n] += below_children
        leaves[n] = leaves[n] + below_leaves if children[n] else 1
        saved[n] += below_saved + (tree.members[n] - 1) * tree.size[n]
        if parent >= 0:
            children[parent] += 1
            leaves[parent] += leaves[n]
            saved[parent] += saved[n]
            up = open_.get(parent)
        parent_conv, parent_path = (None, None) if parent < 0 else (tree.least[parent], None) if up is None else (None, 2 * shard + up)
        root = tree.value[n] if level == 0 else None
        yield (None, level, None, None, root, tree.least[n], parent_conv, parent_path, tree.members[n], children[n], leaves[n], saved[n], tree.size[n], 0, 0, 0, None, hashlib.sha256(_decimals(tree.ends[n] or [])).hexdigest())
    done: set[int] = set()
    for side in (0, 1):
        key = parent_key = None
        for n in edges[side]:
            value = tree.value[n]
            parent_key, key = key, hashlib.md5(value.encode() if key is None else key + value.to_bytes(8, "little")).digest()
            root = value if parents[n] < 0 else None
            partial = (0, 0, 0, 0, tree.size[n], *tree.extra[n], b"")
            if n not in done:
                done.add(n)
                partial = (tree.members[n], children[n], leaves[n], saved[n], tree.size[n], *tree.extra[n], np.array(tree.ends[n] or [], np.int64).tobytes())
            yield (2 * shard + side, levels[n], key, parent_key, root, tree.least[n], None, None, *partial, None)


def _shard_rows(shards: DataFrame) -> DataFrame:
    """_NODES of range shards, each held by one task."""
    names = [x.split()[0] for x in _NODES.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _NODES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if not rows:
            return
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), fields, strict=True)], names)

        for row in _shard_nodes(rows, TaskContext.get().partitionId()):
            held.append(row)
            if len(held) == 10_000:
                yield out()
                held.clear()
        if held:
            yield out()

    return shards.mapInArrow(run, _NODES)


def _end_digests(open_: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the packed ids that the parts of each node have, in order of paths, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for k, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if digest is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(_decimals(np.frombuffer(ends, np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], ["key", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    rows = open_.where("length(ends) > 0").select("key", "ends", "path").repartition("key").sortWithinPartitions("key", "path")
    return rows.select("key", "ends").mapInArrow(run, "key binary, ends_sha256 string")


_OUT = ("conv_id", "level", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _trie(sequences: DataFrame, shard_turns: int) -> DataFrame:
    """(root, *_OUT): nodes of ``sequences(root, ids, sizes, conv_id, ends, below_...)``, root null below level 0."""
    total = sequences.agg(F.sum(F.size("ids") + F.lit(1).cast("long"))).first()[0] or 0
    order = ("root", "ids", "conv_id")
    shards = sequences.select(*order[:2], "sizes", "conv_id", "ends", "below_children", "below_leaves", "below_saved").repartitionByRange(max(1, -(-total // shard_turns)), *order)
    nodes = written(_shard_rows(shards.sortWithinPartitions(*order)))
    open_, done = nodes.where("path IS NOT NULL"), nodes.where("path IS NULL")
    # nodes on the edges of shards: at most two paths a shard, of a segment's length
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    most = [F.max(c).alias(c) for c in ("size", "below_children", "below_leaves", "below_saved", "root", "level", "parent_key")]
    merged = open_.groupBy("key").agg(F.min("conv_id").alias("conv_id"), *sums, *most, F.min("path").alias("owner"))
    kids = merged.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("kids"))
    merged = merged.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)) + F.col("below_children"))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    own = {"own_leaves": F.col("n_leaves") + F.col("below_leaves") + leaf, "own_saved": F.col("saved_tokens") + F.col("below_saved") + (F.col("n_convs") - 1) * F.col("size")}
    merged = written(merged.withColumns(own).select("key", "parent_key", "root", "level", "conv_id", "n_convs", "n_children", "owner", *own))
    on_paths = open_.select("path", "level", "key").join(merged.select("key", "conv_id", "owner", *own), "key")
    down = Window.partitionBy("path").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = lambda c: F.sum(F.when(F.col("owner") == F.col("path"), F.col(c)).otherwise(0)).over(down)
    totals = on_paths.select("key", held("own_leaves").alias("n_leaves"), held("own_saved").alias("saved_tokens")).groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    up = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    edge = merged.join(totals, "key").join(_end_digests(open_), "key", "left").join(up, "parent_key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    places = on_paths.select(F.col("path").alias("parent_path"), (F.col("level") + 1).alias("level"), F.col("conv_id").alias("_up"))
    known = done.where("parent_path IS NULL").select("root", *_OUT)
    hung = done.where("parent_path IS NOT NULL").join(places, ["parent_path", "level"]).withColumn("parent_conv_id", F.col("_up")).select("root", *_OUT)
    return known.unionByName(hung).unionByName(edge.select("root", *_OUT))


def prefix_trie(turns: DataFrame, lengths: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of ``turns(conv_id, depth, key, size)``, depths from 1 on without gaps, of the
    conversations ``lengths(conv_id, n)``, such without turns included: (conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256).

    A node is a distinct sequence of first turns and is told by its least member and depth. n_leaves counts childless
    nodes of its subtree, saved_tokens sums (members - 1) * size of the last turn over it; ends_sha256 digests the
    decimal ids of members that end with it, ascending, comma-joined. No conversations have no nodes.
    """
    segments = written(_segments(_encoded(turns), lengths, segment))
    last = segments.agg(F.max("layer")).first()[0]
    zero = F.lit(0).cast("long")
    out, below = [], None
    for layer in range(last or 0, -1, -1):
        rows = segments.where(F.col("layer") == layer)
        if below is not None:
            rows = rows.join(below, "below", "left").fillna(0, ["below_children", "below_leaves", "below_saved"])
        else:
            rows = rows.withColumns(dict.fromkeys(("below_children", "below_leaves", "below_saved"), zero))
        nodes = written(_trie(rows, shard_turns))
        if layer:
            has = F.when(F.col("n_children") > 0, F.col("n_leaves")).otherwise(0)
            below = nodes.where("level = 0").select(F.col("root").alias("below"), F.col("n_children").alias("below_children"), has.alias("below_leaves"), F.col("saved_tokens").alias("below_saved"))
            nodes = nodes.where("level > 0")
        out.append(nodes.select("conv_id", (F.col("level") + F.lit(layer * segment)).cast("long").alias("depth"), *_OUT[2:]))
    return reduce(DataFrame.unionByName, out)


def conversation_trie(conversations: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The prefix trie of ``conversations(conv_id, turn, role, text)`` after ``rebuild``, as ``prefix_trie`` returns it.

    Turns go by turn (null first), ties by role and text; null role or text is empty; rows without conv_id are left
    out; repeated rows are turns of their own; an empty table has no nodes. Other columns are ignored.
    """
    return prefix_trie(*rebuild(numbered_turns(conversations)), segment, shard_turns)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: crc32 of a decimal id, byte by byte, from a table that is made bit by bit.
_CRC = """bits(i, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
  tab AS (SELECT i, v FROM bits WHERE k = 8),
  crc(conv_id, k, v) AS (SELECT DISTINCT conv_id, 0, 4294967295 FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL SELECT conv_id, k + 1, xor(crc.v >> 8, tab.v) FROM crc JOIN tab ON tab.i = xor(crc.v, ascii(substring(conv_id::VARCHAR, k + 1, 1))) & 255 WHERE k < length(conv_id::VARCHAR))"""
ORACLE_SQL = f"""WITH RECURSIVE {_CRC},
  h AS (SELECT conv_id, xor(v, 4294967295) % 9 AS h, conv_id - conv_id % 5 AS base FROM crc WHERE k = length(conv_id::VARCHAR)),
  t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS a, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
  u AS (SELECT h.conv_id, 0 AS part, a, k, size FROM h JOIN t ON t.conv_id = h.base WHERE a <= h UNION ALL SELECT conv_id, 1, a, k, size FROM t JOIN h USING (conv_id) WHERE a > h),
  s AS (SELECT h.conv_id, coalesce(list(k ORDER BY part, a) FILTER (WHERE k IS NOT NULL), []) AS ks, coalesce(list(size ORDER BY part, a) FILTER (WHERE k IS NOT NULL), []) AS sizes FROM h LEFT JOIN u USING (conv_id) GROUP BY 1),
  r AS (SELECT conv_id, d, len(ks) AS n, md5(array_to_string(ks[:d], ',')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(ks[:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM s)),
  nodes AS (SELECT node, d, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = n), '')) AS ends FROM r GROUP BY 1, 2),
  kids AS (SELECT up AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
  own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children, (n_convs - 1) * size AS saved FROM nodes LEFT JOIN kids USING (node)),
  sums AS (SELECT r.node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved FROM own JOIN r ON r.conv_id = own.conv_id AND r.d <= own.d GROUP BY 1)
  SELECT own.conv_id, own.d AS depth, p.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, sums.saved AS saved_tokens, own.ends AS ends_sha256 FROM own JOIN sums USING (node) LEFT JOIN own p ON p.node = own.up"""
