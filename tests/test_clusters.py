"""Block matching and clustering against the plain rules."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from sieveline.functions import matching
from sieveline.operators import cluster

LETTERS = "ACDEFGHIKLMNPQRSTVWY"
FRAME = "proteome_id string, ord int, sequence string, g string, rows string, seeds int"


def _ratio(a, b):
    return SequenceMatcher(None, a, b, False).ratio()


def _edited(rng, s, rate, letters=LETTERS):
    out = []
    for c in s:
        x = rng.random()
        out += [] if x < rate / 3 else [rng.choice(letters)] if x < 2 * rate / 3 else [c, rng.choice(letters)] if x < rate else [c]
    return "".join(out)


def _pairs():
    rng = random.Random(2)
    for _ in range(300):
        letters = rng.choice(["AB", "ACDE", LETTERS, "AÉ🙂"])
        a = "".join(rng.choices(letters, k=rng.choice([0, 1, 5, 60, 250])))
        yield a, _edited(rng, a, rng.choice([0, 0.1, 0.3])) if rng.random() < 0.7 else "".join(rng.choices(letters, k=rng.choice([0, 1, 40, 250])))


def test_ratio_equals_the_slow_form():
    for a, b in _pairs():
        assert matching.matching_ratio(a, b) == _ratio(a, b)
        for t in (0.5, 0.8, 0.9, 1.0):
            assert matching.ratio_at_least(a, b, t) == (_ratio(a, b) >= t)


def test_bounds_lose_no_pair():
    for a, b in _pairs():
        table = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, table[j] = table[j], last + 1 if x == y else max(table[j], table[j - 1])
        assert matching.common_subsequences(a, [b, "", a]).tolist() == [table[-1], 0, len(a)]
        assert round(_ratio(a, b) * (len(a) + len(b)) / 2) <= table[-1]
        assert np.minimum(matching.counts_of(a)[1], matching.counts_of(b)[1]).sum() >= 3 * table[-1] - 1 - len(a) - len(b)


def _greedy(sequences, word, threshold=0.8):
    """The sequential rule: the first seed that shares a word and is alike, else a new seed."""
    seeds, rep, first = [], {}, {}
    for o, s in sorted(sequences):
        if s in first:
            rep[o] = rep[first[s]]
            continue
        first[s] = o
        words = {s[i : i + word] for i in range(len(s) - word + 1)}
        near = (q for q, t in seeds if any(w in t for w in words) and min(len(s), len(t)) >= threshold * max(len(s), len(t)) and _ratio(t, s) >= threshold)
        rep[o] = next(near, o)
        if rep[o] == o:
            seeds.append((o, s))
    return rep


@pytest.mark.parametrize(("seed", "leaders", "most", "hot"), [(1, 2, 7, 1), (2, 64, 4096, 32), (3, 4, 16, 2)])
def test_clusters_equal_the_sequential_rule(spark, monkeypatch, seed, leaders, most, hot):
    """Families of variants in mixed order, several rounds, words that most sequences have."""
    monkeypatch.setattr(cluster, "FIRST_LEADERS", leaders)
    monkeypatch.setattr(cluster, "MOST_LEADERS", most)
    rng = random.Random(seed)
    sequences = []
    for _ in range(8):
        base = "MKLVAAG" * 2 + "".join(rng.choices(LETTERS, k=rng.choice([40, 90, 160])))
        sequences += [_edited(rng, base, rate) for rate in (0, 0, 0.02, 0.1, 0.2, 0.25, 0.3, 0.4)] + [base[:20], base[:4]]
    rng.shuffle(sequences)
    rows = [("p", o, s, "x", "y", 1) for o, s in enumerate(sequences)] + [(None, o, s, "x", "y", 1) for o, s in enumerate(sequences[:20])]
    rows += [("q", 5, None, "x", "y", 1), ("q", 6, "", "x", "y", 1), ("q", 7, "AAAAAAA", "x", "y", 1)]
    got = {(r.proteome_id, r.ord): r.rep_ord for r in cluster.greedy_clusters(spark.createDataFrame(rows, FRAME)).collect()}
    expected = {("p", o): r for o, r in _greedy(list(enumerate(sequences)), 5).items()} | {(None, o): r for o, r in _greedy(list(enumerate(sequences[:20])), 5).items()}
    assert got == expected | {("q", 5): 5, ("q", 6): 5, ("q", 7): 7}
    assert len(set(expected.values())) < 0.8 * len(sequences)


def test_one_family_of_many_variants(spark):
    """A run of near copies behind other sequences: all join the first of them."""
    rng = random.Random(5)
    base = "".join(rng.choices(LETTERS, k=100))
    rows = [("p", o, "".join(rng.choices(LETTERS, k=100))) for o in range(70)] + [("p", 70 + o, base[:o] + "W" + base[o + 1 :]) for o in range(100)]
    got = {r.ord: r.rep_ord for r in cluster.greedy_clusters(spark.createDataFrame(rows, "proteome_id string, ord int, sequence string")).collect()}
    assert {got[o] for o in range(70, 170)} == {70} and all(got[o] == o for o in range(70))


def test_empty_table(spark):
    assert cluster.greedy_clusters(spark.createDataFrame([], FRAME)).count() == 0


def test_clusters_of_the_query_equal_the_sequential_rule(spark, data):
    from sieveline.plans import views
    from sieveline.plans.operations import QUERIES

    proteins = views.proteins(spark, data).select("proteome_id", "ord", "sequence").collect()
    got = {(r.proteome_id, r.ord): r.rep_ord for r in QUERIES["c24_greedy_cluster"](spark, data).collect()}
    expected = {}
    for p in {r.proteome_id for r in proteins}:
        own = [(r.ord, r.sequence or "") for r in proteins if r.proteome_id == p]
        assert len(own) <= 1000
        expected |= {(p, o): r for o, r in _greedy(own, 5).items()}
    assert got == expected


def test_global_identity_of_the_query_equals_the_slow_form(spark, data):
    from sieveline.plans import views
    from sieveline.plans.operations import QUERIES

    got = {(r.proteome_id, r.ord): r.identity for r in QUERIES["c21_global_identity"](spark, data).collect()}
    by = {}
    for r in views.proteins(spark, data).select("proteome_id", "ord", "sequence").collect():
        by.setdefault(r.proteome_id, []).append((r.ord, r.sequence))
    expected = {}
    for p, rows in by.items():
        for (o, a), (_, b) in zip(sorted(rows), sorted(rows)[1:], strict=False):
            if len(a) * len(b) < 300_000:
                expected[p, o] = round(_ratio(a, b), 6)
    assert len(expected) > 50 and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in expected.items())


def test_block_matching_looks_at_few_sizes_and_slots_lose_nothing(monkeypatch):
    import random
    from difflib import SequenceMatcher

    import numpy as np

    from sieveline.functions import matching

    rng = random.Random(11)
    some = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    for n, letters in ((700, "AB"), (500, "A"), (600, "ACDEFGHIKLMNPQRSTVWY")):
        a = some(n, letters)
        b = some(90, letters) + a[50:300] + some(40, letters) + a[320:]
        assert matching.matched(a, b) == sum(m.size for m in SequenceMatcher(None, a, b, False).get_matching_blocks())
    x, y = np.array([5, 5, 9, 0, 2**63], np.uint64), np.array([0, 9, 1], np.uint64)
    assert matching._shared(x, y).tolist() == [False, False, True, True, False] and not matching._shared(x, y[:0]).any()
    looked, blocks = [], matching.Hashed.blocks

    def counted(self, *at):
        looked.append(at)
        return blocks(self, *at)

    monkeypatch.setattr(matching.Hashed, "blocks", counted)
    matching.matched(some(3000, "ACDEFGHIKLMNPQRSTVWY"), some(3000, "ACDEFGHIKLMNPQRSTVWY"))
    assert len(looked) < 600


def _slow_pairs(sequences, word, threshold=0.8):
    """The rule of the SQL: distinct words by (proteome, ord, length), pairs of different ords."""
    words = {}
    for p, o, s in sequences:
        if p is not None and o is not None and s is not None and len(s) >= word:
            words.setdefault((p, o, len(s)), set()).update(s[i : i + word] for i in range(len(s) - word + 1))
    out = {}
    for (p, a, m), x in words.items():
        for (q, b, n), y in words.items():
            if p == q and a < b and min(m, n) >= threshold * max(m, n) and x & y:
                out[p, a, b] = out.get((p, a, b), 0) + len(x & y)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_candidate_pairs_of_blocks_equal_the_slow_form(spark, monkeypatch, small):
    if small:  # many blocks, partners in turns, small batches
        for name, value in {"BLOCK_ROWS": 7, "BLOCK_LETTERS": 500, "PARTNERS": 2, "OUT_ROWS": 5}.items():
            monkeypatch.setattr(cluster, name, value)
    rng = random.Random(5)
    sequences = [("q", None, "ACDEFGHIKL" * 3), (None, 1, "ACDEFGHIKL" * 3), (None, 2, "ACDEFGHIKLM" * 3), ("q", 3, None), ("q", 4, ""), ("q", 5, "ACD"), ("u", 1, "ÉA🙂CDE"), ("u", 2, "ÉA🙂CDF")]
    for p in "pq":
        for o in range(60):
            s = "".join(rng.choices("ACDE", k=rng.choice([5, 20, 60, 62, 70])))
            sequences += [(p, o, s)] if rng.random() < 0.8 else [(p, o, s), (p, o, s[::-1]), (p, o, s + "AC")]  # an ord with several sequences
    frame = spark.createDataFrame(sequences, "proteome_id string, ord long, sequence string")
    got = [((r.proteome_id, r.a, r.b), r.shared) for r in cluster.candidate_pairs(frame, 5).collect()]
    assert len(got) == len(dict(got)) and dict(got) == _slow_pairs(sequences, 5)
    assert cluster.candidate_pairs(frame.filter("false"), 5).count() == 0


def test_candidate_pairs_exchange_no_words_and_no_pairs(spark):
    import re

    rng = random.Random(6)
    common = "".join(rng.choices(LETTERS, k=300))  # all of a proteome share its words
    frame = spark.createDataFrame([("p", o, "".join(rng.choices(LETTERS, k=10)) + common) for o in range(200)], "proteome_id string, ord int, sequence string")
    found = cluster.candidate_pairs(frame, 24)
    assert found.count() == 200 * 199 // 2
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Generate|explode", plan) and "shared" not in "".join(x for x in plan.splitlines() if "Exchange" in x or "HashAggregate" in x)


def test_pairs_of_two_blocks_are_counted_in_steps(monkeypatch):
    import pyarrow as pa

    rng = random.Random(7)
    block = lambda low: [("p", low + o // 2, "".join(rng.choices("AC", k=rng.choice([9, 30, 33])))) for o in range(40)]
    one, two = block(0), block(100)
    row = lambda rows: cluster._packed_block(pa.table({"proteome_id": [r[0] for r in rows], "k": [4] * 40, "at": [0] * 40, "part": [0] * 40, "ord": [r[1] for r in rows], "n": [len(r[2]) for r in rows], "sequence": [r[2] for r in rows]})).to_pylist()[0]  # noqa: E731, E501
    for step, cells in ((1 << 23, 1 << 26), (1 << 23, 100), (50, 1 << 26), (50, 100), (1, 1)):
        monkeypatch.setattr(cluster, "STEP", step)
        monkeypatch.setattr(cluster, "CELLS", cells)
        got = {}
        for x, y in ((one, one), (one, two), (two, two)):
            for a, b, shared in cluster._pairs_of(cluster._Holder(row(x)), cluster._Block(row(y)), x is y, 0.8):
                found = {("p", *k): v for k, v in zip(zip(a.tolist(), b.tolist()), shared.tolist(), strict=True)}
                assert len(found) == len(a) and not found.keys() & got.keys()
                got |= found
        assert got == _slow_pairs(one + two, 4)


def test_line_pairs_have_the_words_of_the_clustering(spark, tmp_path):
    """Two lines at identity 0.9 that share words of 9, none of 24."""
    from sieveline.plans.operations import QUERIES

    line = "ACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQRSTVWY"
    other = "".join("W" if i % 10 == 9 else c for i, c in enumerate(line))
    rows = [(1, line + "\n" + other, "en", "p", 81), (2, "MMMM", "en", "p", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.proteome_id, r.a, r.b) for r in QUERIES["j6_cluster_candidate_pairs"](spark, str(tmp_path)).collect()] == [("p", 1000000, 1000001)]


@pytest.mark.parametrize(("letters", "most"), [(1 << 17, 1 << 21), (600, 1 << 21), (1 << 17, 400)])
def test_many_pairs_at_once_equal_the_slow_form(monkeypatch, letters, most):
    """Batches of any size, also where common blocks are too many for one."""
    monkeypatch.setattr(matching, "BATCH_LETTERS", letters)
    monkeypatch.setattr(matching, "MOST_MATCHES", most)
    pairs = [*_pairs(), ("A" * 90, "A" * 70), ("AB" * 60, "BA" * 50), ("\0A", "A\0"), ("ACD", "ACD")]
    expected = [round(_ratio(a, b) * (len(a) + len(b)) / 2) for a, b in pairs]
    assert matching.matched_many(pairs).tolist() == expected
    for t in (0.3, 0.8, 1.0):
        enough = np.array([matching.letters_needed(len(a), len(b), t) if a or b else 0 for a, b in pairs])
        assert ((matching.matched_many(pairs, enough) >= enough) == (np.array(expected) >= enough)).all()
    assert matching.matched_many([]).tolist() == []


def test_identity_ratio_keeps_nulls(spark):
    rows = [("ACDA", "ACEA"), (None, "A"), ("A", None), ("", ""), ("ACD", "")]
    from sieveline.functions.helpers import identity_ratio

    assert [r[0] for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(identity_ratio("a", "b")).collect()] == [0.75, None, None, 1.0, 0.0]


def test_identity_to_next_over_ranges_equals_the_window(spark):
    """Neighbours also where a range ends, in proteomes of one sequence, a null one, and beside null sequences."""
    rng = random.Random(8)
    rows = [(p, o, "".join(rng.choices("ACDE", k=rng.choice([0, 5, 30]))) if rng.random() < 0.9 else None) for p, n in (("p", 70), ("q", 1), (None, 3), ("r", 40)) for o in range(n)]
    rng.shuffle(rows)
    expected = {}
    for p in ("p", "q", None, "r"):
        own = sorted((o, s) for q, o, s in rows if q == p)
        expected |= {(p, o): None if s is None else _ratio(s, t) for (o, s), (_, t) in zip(own, own[1:], strict=False) if t is not None}
    frame = spark.createDataFrame(rows, "proteome_id string, ord int, sequence string")
    got = cluster.identity_to_next(frame)
    assert {(r.proteome_id, r.ord): r.identity for r in got.collect()} == expected and got.count() == len(expected) and len(expected) > 90
    assert cluster.identity_to_next(frame.filter("false")).count() == 0


@pytest.mark.parametrize("most", [1 << 22, 50])
def test_few_seeds_of_a_common_passage_are_matched(monkeypatch, most):
    """All sequences have one passage at places of their own: its places part them before they are matched, and no link is lost."""
    monkeypatch.setattr(cluster, "MOST_PLACES", most)
    rng = random.Random(9)
    passage, rows = "".join(rng.choices(LETTERS, k=40)), []
    for _ in range(60):
        s = "".join(rng.choices(LETTERS, k=400))
        at = rng.randrange(400)
        rows.append(s[:at] + passage + s[at:])
    strings = [_edited(rng, rows[o], 0.1) for o in range(0, 60, 6)] + ["".join(rng.choices(LETTERS, k=200)) + passage + "".join(rng.choices(LETTERS, k=200)), "ACD", ""]
    seeds = cluster.Seeds([{"ord": o, "sha": b"", "sequence": s} for o, s in enumerate(rows)], 7)
    tried = []
    monkeypatch.setattr(cluster, "matched_many", lambda pairs, need: tried.extend(pairs) or matching.matched_many(pairs, need))
    before = [60] * 8 + [30] * 2 + [60] * 3
    got = seeds.joined(strings, before, 0.8, False)
    assert got == [[o for o in range(b) if len(s) >= 7 and _ratio(rows[o], s) >= 0.8] for s, b in zip(strings, before, strict=True)] and sum(map(len, got)) >= 8
    assert len(tried) < 0.4 * 11 * 60
    assert [x[:1] for x in got] == seeds.joined(strings, before, 0.8, True)
