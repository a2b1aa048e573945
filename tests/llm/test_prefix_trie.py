import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from basewright.llm import prefix_trie


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, held in members.items():
        ends = ",".join(str(c) for c in sorted(held) if len(convs[c]) == len(node))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["hi", "Ünï", "", None, "a:b", "x" * rng.randrange(1, 4)]))
    openings = [[turn() for _ in range(rng.randrange(1, 6))] for _ in range(4)]
    rows = []
    for c in rng.sample(range(3 * n), n):
        turns = (rng.choice(openings) if rng.random() < 0.7 else []) + [turn() for _ in range(rng.randrange(0, 6))]
        rows += [(c, k if rng.random() < 0.95 else rng.choice([None, 2]), *t) for k, t in enumerate(turns)]
    same = [turn() for _ in range(14)]
    rows += [(c, k, *t) for c in range(1000, 1040) for k, t in enumerate(same)]  # a frequent conversation
    rows += [(2000, k, *turn()) for k in range(40)] + [(2001, k, "user", "r") for k in range(30)]
    rows += [(None, 0, "user", "nobody's"), (7, None, None, None), (7, None, None, None), rows[0], rows[0]]
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def got(df):
    return Counter((r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


@pytest.mark.parametrize(("segment", "shard_turns"), [(4096, 200_000), (4096, 25), (14, 25), (10, 300)])
def test_nodes_against_all_prefixes(spark, segment, shard_turns):
    rows = corpus(segment)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(prefix_trie.conversation_trie(df, segment, shard_turns)) == brute(rows)


def test_tree_is_searched_in_few_steps():
    tree = prefix_trie.Tree()
    for i in prefix_trie.medians(1000):
        tree.insert(["", i], [0, 1], [i], [i], (0, 0, 0))
    depth = {0: 0}
    for node in range(len(tree.value)):
        for link in (tree.less, tree.more, tree.down):
            if link[node] >= 0:
                depth[link[node]] = depth[node] + 1
    assert max(depth.values()) <= 11
    assert sorted(n for n, _, _ in tree.walk()) == list(range(1001))


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "user", "gone"), (c, 1, "user", "gone too")]  # fewer than it would take over, from no one
    nodes = prefix_trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["conv_id"], r["depth"], r["n_convs"], r["n_leaves"], r["ends_sha256"]) for r in nodes] == [(c, 0, 1, 1, hashlib.sha256(str(c).encode()).hexdigest())]


def test_empty_tables_and_clashing_columns(spark):
    rows = corpus(5, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    assert not got(prefix_trie.conversation_trie(df.limit(0)))
    names = ("depth", "key", "size", "at", "root", "ids", "path", "level", "layer", "n", "h", "base")
    assert got(prefix_trie.conversation_trie(df.withColumns(dict.fromkeys(names, F.lit("x"))))) == brute(rows)
