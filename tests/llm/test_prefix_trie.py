"""Operator 11 against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sieveline.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, digest string, depth long"


def expected(rows):
    """Nodes of rebuilt conversations by plain Python."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), digest, role, text))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
    nodes = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    children = defaultdict(set)
    for path in nodes:
        if path:
            children[path[:-1]].add(path)
    out = {}
    for path in sorted(nodes, key=len, reverse=True):
        below = [out[k] for k in children[path]]
        saved = (len(nodes[path]) - 1) * (len(path[-1][1].encode()) if path else 0) + sum(b[6] for b in below)
        ends = ",".join(map(str, sorted(c for c in nodes[path] if rebuilt[c] == path)))
        parent = min(nodes[path[:-1]]) if path else None
        leaves = sum(b[5] for b in below) or 1
        out[path] = (min(nodes[path]), len(path), parent, len(nodes[path]), len(children[path]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def nodes_of(spark, rows):
    made = spark.createDataFrame(rows, TURNS).repartition(5)
    placed = prefix_trie.written(prefix_trie.placed_turns(made), "test")
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(*prefix_trie.rebuilt_turns(placed)).collect()), key=str)


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(300), 120):
        for turn in range(rng.choice([0, 1, 2, 3, 8, 12])):
            rows.append((c, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "", None, "é" * 9]), "x", 7))
    rows += rows[:20]  # repeated rows
    rows += [(None, 1, "user", "a", "x", 1), (900, None, None, None, None, None)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_nodes_equal_brute_force(spark, seed):
    rows = random_rows(seed)
    assert nodes_of(spark, rows) == expected(rows)


def test_long_conversations_and_lists_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    monkeypatch.setattr(prefix_trie, "LIST_BITS", 3)
    rows = [(c, t, "u", f"{t % 5}", "x", 1) for c in range(1, 60) for t in range(3)] + [(c, t, "u", "same", "x", 1) for c in (100, 105, 110) for t in range(40 + c % 4)]
    assert nodes_of(spark, rows) == expected(rows)


def test_ambiguous_joins_of_role_and_text_stay_apart(spark):
    rows = [(5, 0, "ab", "c", "x", 1), (10, 0, "a", "bc", "x", 1), (15, 0, "", "abc", "x", 1), (20, 0, None, "abc", "x", 1)]
    assert nodes_of(spark, rows) == expected(rows)
    assert len(nodes_of(spark, rows)) == 4


def test_empty_table(spark):
    assert nodes_of(spark, []) == []


def test_leaf_sequences_write_every_node_once(spark):
    rows = random_rows(3)
    made = spark.createDataFrame(rows, TURNS)
    got = prefix_trie.leaf_sequences(made).collect()
    turns = defaultdict(list)
    for r in prefix_trie.placed_turns(made).collect():
        turns[r.conv_id].append((r.pos, r.digest))
    paths = {c: tuple(d for _, d in sorted(v)) for c, v in turns.items()}
    nodes = {p[:d] for p in paths.values() for d in range(1, len(p) + 1)}
    assert len(got) == len(nodes) and {paths[r.conv_id][: r.pos + 1] for r in got} == nodes
    assert sum(r.n_ends for r in got) == len(paths)


def test_turn_digest_reads_whole_texts(spark):
    long = "y" * 100_000
    made = spark.createDataFrame([("u", long + "1"), ("u", long + "2")], "role string, text string")
    assert made.select(prefix_trie.turn_digest(F.col("role"), F.col("text"))).distinct().count() == 2
