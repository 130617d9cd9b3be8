"""Operator 12 against brute force over all n-grams."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline.llm import lm_scoring
from sieveline.llm.common import read_table

DOCS = "doc_id long, text string, score double, words string"


def expected(rows, order, mass):
    """(n_tokens, n_known, base, score) by document, from n-gram counts of the training documents."""
    texts = [(d, ["<s> ", *(w.decode() for w in (t or "").encode().lower().split()), "</s> "]) for d, t, *_ in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in texts]
    counts = Counter()
    for (_, words), h in zip(texts, held, strict=True):
        if not h:
            counts.update(tuple(words[i : i + m]) for m in range(1, order + 1) for i in range(len(words) - m + 1))
    single = {k[0]: v for k, v in counts.items() if len(k) == 1 and k[0] != "<s> "}
    n, v = sum(single.values()), len(single)

    def p(context, w):
        if not context:
            return (single.get(w, 0) + 1) / (n + v + 1)
        return (counts[(*context, w)] + mass * p(context[1:], w)) / (counts[context] + mass)

    out = []
    for (d, words), h in zip(texts, held, strict=True):
        scored = words[1:]
        base = sum(math.log10(p((), w)) for w in scored)
        score = sum(math.log10(p(tuple(words[max(0, i - order + 1) : i]), words[i])) for i in range(1, len(words)))
        out.append((d, not h, len(scored), sum(w in single for w in scored), n, round(base, 8), round(score, 8)))
    return sorted(out, key=str)


def scores(made, order, mass):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = lm_scoring.score_documents(made, ~held, order, mass).collect()
    return sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 8), round(r[6], 8)) for r in got), key=str)


def random_rows():
    rng = random.Random(5)
    words = ["the", "The", "a", "é", "É", "b\x1c", "c", "s", "<s>", "</s>", "long" * 30]
    rows = [(i, rng.choice(["", " ", "\n"]) + rng.choice([" ", "\t\r\n", "  "]).join(rng.choices(words, k=rng.choice([0, 1, 2, 9, 40]))), 0.5, "x") for i in range(150)]
    rows += [*rows[:7], (None, "a b", None, None), (None, None, None, None), (500, None, 1.0, "x"), (501, "", 1.0, "x"), (502, "never seen words " * 3, 1.0, "x")]
    return [*rows, (503, " ".join(rng.choices(words, k=20_000)), 0.0, "x")]


@pytest.mark.parametrize(("order", "mass"), [(1, 4.0), (2, 4.0), (3, 1.5), (4, 2.0)])
def test_scores_equal_brute_force(spark, monkeypatch, order, mass):
    monkeypatch.setattr(lm_scoring, "BATCH_TOKENS", 300)  # only here: workers read the module anew
    monkeypatch.setattr(lm_scoring, "BATCH_TOKENS", 300)
    rows = random_rows()
    assert scores(spark.createDataFrame(rows, DOCS).repartition(4), order, mass) == expected(rows, order, mass)


def test_empty_table_and_no_training_documents(spark):
    assert scores(spark.createDataFrame([], DOCS), 2, 4.0) == []
    got = lm_scoring.score_documents(spark.createDataFrame([(1, "a b", 0.0, "x")], DOCS), F.lit(False)).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score, got.score) == (3, 0, 0, 0.0, 0.0)


def test_held_out_text_is_likelier_than_its_shuffle(spark, data):
    """The model knows the order of words: most held-out documents score above their own words in random order."""
    docs = read_table(spark, data, "documents").select("doc_id", "text")
    rng = random.Random(1)
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 2 and len((r.text or "").split()) > 30]
    mixed = [(100_000 + r.doc_id, " ".join(rng.sample(r.text.split(), len(r.text.split())))) for r in held]
    both = docs.unionByName(spark.createDataFrame(mixed, "doc_id long, text string"))
    ids = [r.doc_id for r in held] + [m[0] for m in mixed]
    got = {r.doc_id: r.score for r in lm_scoring.score_documents(both, ~F.col("doc_id").isin(ids)).collect()}
    better = sum(got[r.doc_id] > got[100_000 + r.doc_id] for r in held)
    assert len(held) > 5 and better >= 0.8 * len(held)


def test_probabilities_of_a_state_sum_to_one():
    texts = pa.array(["a b a c", "b a b", "a a a b c"])
    words, codes, lengths = lm_scoring.encode_batch(texts)
    levels = lm_scoring.grams_of(words, codes, lengths, 3)
    counts = [np.bincount(g.at[g.at >= 0], minlength=len(g.keys)) for g in levels]
    n = int(counts[0][words != lm_scoring.START].sum())
    model = lm_scoring.Automaton(levels, counts, n, len(words) - 1, 2.0)
    vocabulary = np.flatnonzero(words != lm_scoring.START)
    for state in range(1 + len(levels[0].keys) + len(levels[1].keys)):  # full n-grams are arcs only
        weights, _ = model.step(np.full(len(vocabulary), state), vocabulary)
        unseen = 1 / (n + len(words))
        at = state
        while at:
            unseen *= 10 ** model.fail_weight[at]
            at = model.fail_to[at]
        assert np.isclose((10**weights).sum() + unseen, 1) or _ends(levels, words, state)


def _ends(levels, words, state):
    """States that end a text have no arcs: their counts are no counts of followers."""
    at = state - 1
    for g in levels:
        if at < len(g.keys):
            return words[levels[0].at[g.first[at]]] == lm_scoring.END
        at -= len(g.keys)
    return False


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    for n in (1, 2, 1000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert (lm_scoring._unpack(lm_scoring._pack(keys)) == keys).all()
