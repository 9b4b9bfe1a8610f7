"""The prefix trie against a trie of nested dictionaries, and subtree sums of random forests."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelflife.llm import centroids, prefix_trie
from shelflife.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
TURNS = StructType(
    [StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType())]
    + [StructField(c, LongType()) for c in ("depth", "key", "_block", "len", "row.s")]
)


def rebuilt(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs[conv].append(((turn is not None, turn or 0), digest, role, text))
    whole = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    out = {}
    for c in whole:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = whole.get(base, [])[:h] + whole[c][h:]
    return out


def plain_trie(convs):
    """Nodes by walking every prefix of every conversation."""
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(node[-1][1].encode().split()) if node else 0
        leaves[node] = sum(leaves[k] for k in kids[node]) if kids[node] else 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[k] for k in kids[node])
    out = Counter()
    for node, ids in members.items():
        ends = ",".join(str(c) for c in ids if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out[(min(ids), len(node), parent, len(ids), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in QUERIES["op11_prefix_trie"](spark, SF).collect()) == plain_trie(rebuilt(rows))


def odd_turns(seed=5):
    rng = random.Random(seed)
    words = ["yes", "no", "go on", "", None, "a b  c\td", "ünï codé", "x" * 5000]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words[:4] if t < 3 else words)) for c in range(-45, 70, 2) for t in range(rng.randint(1, 9))]
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(3)]  # equal conversations
    rows += [(c, None, "user", "first") for c in range(0, 60, 7)] + [(c, 1, "user", "tie") for c in (3, 5, 5, 5, 101)]
    rows += [(100, t, "user", "ha") for t in range(300)] + [(120, t, "user", "ha" if t < 250 else "ho") for t in range(280)]  # long chains
    rows += [(None, 0, "user", "lost"), (21, None, None, None), (10**12, 0, "user", "far")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("whole, block", [(1 << 14, 1 << 12), (40, 16), (1, 1 << 12)])
def test_odd_rows(spark, monkeypatch, whole, block):
    """Also with components split on all executors, down to single nodes, and with long conversations in blocks."""
    for module in (centroids, prefix_trie):
        monkeypatch.setattr(module, "BLOCK", block)
    rows = odd_turns()
    if whole == 1:
        rows = [r for r in rows if r[0] not in (100, 120)]
    table = spark.createDataFrame([(*r, *range(5)) for r in rows], TURNS).repartition(3)
    turns, lengths = prefix_trie.rebuilt_prefixes(prefix_trie.numbered_turns(table))
    found = prefix_trie.prefix_trie(turns, lengths, whole).drop("n_ends")
    assert Counter(tuple(r) for r in found.collect()) == plain_trie(rebuilt(rows))


def test_conversations_as_they_are_and_none(spark):
    rows = [(c, t, "user", f"{t}") for c in range(5) for t in range(c + 1)]
    table = spark.createDataFrame([(*r, *range(5)) for r in rows], TURNS)
    nodes = prefix_trie.prefix_trie(*prefix_trie.plain_prefixes(prefix_trie.numbered_turns(table))).collect()
    assert Counter((r["conv_id"], r["depth"], r["n_convs"], r["n_ends"], r["n_leaves"], r["saved_tokens"]) for r in nodes) == Counter(
        [(0, 0, 5, 0, 1, 10)] + [(d - 1, d, 6 - d, 1, 1, sum(5 - k for k in range(d, 6))) for d in range(1, 6)]
    )
    empty = prefix_trie.numbered_turns(table.limit(0))
    assert prefix_trie.prefix_trie(*prefix_trie.rebuilt_prefixes(empty)).count() == 0


def test_turns_are_numbered_across_blocks(spark):
    rows = [(1, t % 50, "user", f"{t % 3}", *range(5)) for t in range(6000)] + [(2, None, None, None, *range(5))] * 500
    table = spark.createDataFrame(rows, TURNS)
    found = prefix_trie.numbered_turns(table).orderBy("conv_id", "pos").collect()
    assert [(r["conv_id"], r["pos"]) for r in found] == [(1, p) for p in range(1, 6001)] + [(2, p) for p in range(1, 501)]


def test_forest_sums():
    import numpy as np

    rng = random.Random(1)
    for n in (1, 2, 50, 400):
        parent = [-1] + [rng.randrange(max(0, i - 3), i) if rng.random() < 0.8 else 0 for i in range(1, n)]
        depth = [0] * n
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        own = np.array([[1] * n, [rng.randint(0, 9) for _ in range(n)]])
        want, weight = own.copy(), np.array([rng.randint(1, 5) for _ in range(n)])
        for i in range(n - 1, 0, -1):
            want[:, parent[i]] += want[:, i]
            weight[parent[i]] += weight[i]
        ids = np.array(rng.sample(range(10**6), n))
        got = centroids.forest_sums(
            np.full(n, ids[0]), np.zeros(n, int), ids, np.array(depth), np.array([ids[p] if p >= 0 else 0 for p in parent]), weight, own
        )
        assert (got == want).all()
