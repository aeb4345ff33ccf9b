import hashlib
import random
import zlib

import pytest

from creditlake.llm import prefix_trie
from creditlake.llm.queries import op12_prefix_trie
from tests.conftest import SF001

COLS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + ts[h:])
    members, children = {}, {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
            if d:
                children.setdefault(seq[:d - 1], set()).add(seq[:d])
    saved, leaves = {}, {}
    for node in sorted(members, key=len, reverse=True):
        kids = children.get(node, ())
        leaves[node] = sum(leaves[k] for k in kids) if kids else 1
        saved[node] = sum(saved[k] for k in kids) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted(
        (min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), len(children.get(node, ())), leaves[node], saved[node],
         hashlib.sha256(",".join(str(c) for c in sorted(ms) if built[c] == node).encode()).hexdigest())
        for node, ms in members.items())


def got(spark, conversations):
    convs, turns = prefix_trie.rebuild(prefix_trie.hashed(prefix_trie.turns(conversations)))
    found = prefix_trie.with_end_hashes(*prefix_trie.trie(convs, turns))
    return sorted((tuple(r[c] for c in COLS) for r in found.collect()), key=lambda r: (r[0], r[1]))


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = sorted(tuple(r) for r in op12_prefix_trie(spark, SF001).select(*COLS).collect())
    assert sorted(found, key=lambda r: (r[0], r[1])) == sorted(brute(rows), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("block", [4096, 2])
def test_edge_rows(spark, monkeypatch, block):
    """Nulls everywhere, ties, repeated rows, absent bases, turnless and identical
    conversations, a long conversation and a long text, small blocks and chunks."""
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "END_IDS", block)
    rnd = random.Random(3)
    rows = [(None, 1, "user", "no conversation"), (700, None, None, None), (700, None, "user", "x"), (700, 1, "user", None)]
    for c in [0, 1, 2, 3, 5, 7, 8, 10, 11, 100, 101, 117, 199, 250, 251, 299, -5, -205, 1000, 1001]:
        rows += [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bb", "", None])) for t in range(rnd.randint(1, 7))]
    rows += [(c, t, "user", "hi") for c in range(300, 340) for t in range(3)]
    rows += [(400, t % 97, "user", f"{t % 5}") for t in range(500)] + [(401, 1, "user", "same")] * 40 + [(402, 1, "user", "w " * 50_000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "conv_id long, turn long, role string, text string, depth int, x string")
    assert got(spark, df.repartition(5)) == sorted(brute(rows), key=lambda r: (r[0], r[1]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert got(spark, df) == []


def test_last_turns(spark):
    rows = [(1, 1, "user", "q"), (1, 2, "bot", "a"), (2, 1, "user", "q"), (2, 2, "bot", "other")]
    turns = prefix_trie.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    nodes, _ = prefix_trie.trie(turns.select("conv_id").distinct(), prefix_trie.hashed(turns))
    found = {(r.depth, r.role, r.text, r.n_convs) for r in prefix_trie.last_turns(nodes, turns).collect()}
    assert found == {(0, None, None, 2), (1, "user", "q", 2), (2, "bot", "a", 1), (2, "bot", "other", 1)}
