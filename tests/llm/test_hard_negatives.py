"""Operator 13 against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import hard_negatives as hn

ROWS = "vec_id long, embedding array<float>, label int, score long, width int"


def expected(rows):
    kept = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label, *_ in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, la, va in kept:
        if a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in kept if i != a]
        positives = sorted((s for s in scored if s[2] == la), key=lambda s: (-s[0], s[1]))[:5]
        for ps, p, _ in positives:
            negatives = sorted((s for s in scored if s[2] != la and 30 * ps <= 100 * s[0] <= 90 * ps), key=lambda s: (-s[0], s[1]))[:10]
            out += [(a, p, rank, n, ps, ns) for rank, (ns, n, _) in enumerate(negatives, 1)]
    return sorted(out)


def found(spark, rows):
    made = spark.createDataFrame(rows, ROWS).repartition(3)
    return sorted(tuple(r) for r in hn.hard_negatives(made, F.col("vec_id") % 100 == 0).collect())


def random_rows(seed, n=700, width=24, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    labels = rng.integers(0, clusters, n)
    v = centres[labels] + rng.normal(size=(n, width))
    v = np.round(v / np.linalg.norm(v, axis=1, keepdims=True), 2)  # many ties
    return [(int(i), [float(x) for x in v[i]], int(labels[i]), 1, 2) for i in range(n)]


@pytest.mark.parametrize(("seed", "width"), [(1, 24), (2, 3), (3, 17)])
def test_equals_brute_force(spark, seed, width):
    rows = random_rows(seed, width=width)
    assert found(spark, rows) == expected(rows) != []


def test_odd_rows(spark):
    rows = random_rows(4, 300)
    one = rows[100][1]
    odd = [(1000, None, 1, 1, 2), (1100, one, None, 1, 2), (None, one, 1, 1, 2), (1200, [None, *one[1:]], 1, 1, 2), (1300, [float("nan"), *one[1:]], 1, 1, 2), (1400, [float("inf"), *one[1:]], 1, 1, 2)]
    odd += [(1500, one[:5], 1, 1, 2), (1600, one + one, 1, 1, 2), (1700, [], 1, 1, 2), (1800, [0.0] * 24, 1, 1, 2), rows[7], rows[100]]
    assert found(spark, rows + odd) == expected(rows + odd)


def test_large_components_are_scored_exactly(spark):
    rows = [(i, [x * 1000.0 for x in v], label, 1, 2) for i, v, label, *_ in random_rows(5, 250)]
    assert found(spark, rows) == expected(rows)
    rows = [(i, [x * 1e6 for x in v[:3]], label, 1, 2) for i, v, label, *_ in random_rows(6, 250)]
    assert found(spark, rows) == expected(rows)


def test_same_vectors_many_times_and_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(hn, "COMPONENTS", 100)
    base = random_rows(7, 400, 8)
    rows = [(i, base[0][1] if i % 3 == 0 else v, label, 1, 2) for i, v, label, *_ in base]
    assert found(spark, rows) == expected(rows)


def test_empty_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1, 1, 2)]) == []


def test_bounds_hold_at_every_level():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-300, 300, (50, 21)), rng.integers(-300, 300, (40, 21))
    for length in hn.LEVELS:
        x, y = hn.summaries(a, length).astype(float), hn.summaries(b, length).astype(float)
        middle, reach = x[0] @ y[0].T, x[1] @ y[1].T + 1
        assert (np.abs(a @ b.T - middle) <= reach).all()
