"""Boundary rows of the screening rules, parsers and streams on small inputs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions import scoring
from sieveline.functions.helpers import covariance_score, isoelectric_point, matching_ratio
from sieveline.operators import cluster, epitopes, hits, proteome, residues, runs, structure
from sieveline.sources import formats
from sieveline.streaming.events import apply_event

HIT = "query_id string, subject_id string, identity double, align_length int, neg_log10_e int, bitscore double, hit_ord int"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("identity", [29.9, 30.0, 45.0])
@pytest.mark.parametrize("e", [3, 4, 5])
@pytest.mark.parametrize("bits", [99.9, 100.0, 100.1])
def test_virulence_edges(spark, identity, e, bits):
    candidates = spark.createDataFrame([("q",), ("none",)], "query_id string")
    found = hits.virulence_flag(candidates, spark.createDataFrame([("q", "s", identity, 100, e, bits, 1)], HIT))
    flags = {r.query_id: r.is_virulent for r in found.collect()}
    assert flags == {"q": identity >= 30 and e >= 4 and bits > 100, "none": False}


def test_essential_takes_the_first_hit(spark):
    rows = [("a", "s", 40.0, 100, 5, 1.0, 1), ("b", "s", 39.0, 100, 5, 1.0, 1), ("b", "t", 90.0, 100, 9, 1.0, 2), ("c", "s", 40.0, 100, 4, 1.0, 1)]
    candidates = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "query_id string")
    assert [r.query_id for r in hits.essential_filter(candidates, spark.createDataFrame(rows, HIT)).collect()] == ["a"]


def test_human_homology_edges(spark):
    rows = [(q, "s", i, 100, 5, 1.0, 1) for q, i in (("a", 29.0), ("b", 30.0), ("c", 31.0))]
    candidates = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "query_id string")
    kept = hits.exclude_homologs(candidates, spark.createDataFrame(rows, HIT))
    assert sorted(r.query_id for r in kept.collect()) == ["a", "d"]


def test_dedup_prefers_reviewed_and_keeps_unknown(spark):
    rows = [("p", 1, "P1", "A", False), ("p", 2, "P1", "B", True), ("p", 3, "?", "C", False), ("p", 4, "?", "C", False), ("p", 5, "P2", "D", None)]
    out = proteome.dedup_accession(spark.createDataFrame(rows, "proteome_id string, ord int, accession string, sequence string, reviewed boolean"))
    assert sorted((r.accession, r.sequence, r.first_ord) for r in out.collect()) == [("?", "C", 3), ("?", "C", 4), ("P1", "B", 1), ("P2", "D", 5)]


def test_fasta_round_trip(spark, tmp_path):
    text = ">tr|P1|PROT one\nMK\nLV\n>sp|P1|PROT\nMKLV\n>plain header\nAC\n>tr|P2|OTHER\n\n"
    (tmp_path / "x.fasta").write_text(text)
    records = formats.read_fasta(spark, str(tmp_path / "x.fasta"), "p")
    got = {(r.accession, r.name, r.sequence, r.reviewed) for r in records.collect()}
    assert got == {("P1", "PROT", "MKLV", False), ("P1", "PROT", "MKLV", True), ("?", "plain header", "AC", False), ("P2", "OTHER", "", False)}
    good, bad = formats.strict_fasta(records)
    assert good.count() == 2 and bad.count() == 2


def test_predictions_take_the_first_rank_that_parses(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("allele\tseq_num\tstart\tend\tlength\tpeptide\tcore\tconsensus_percentile_rank\trank\nA\t1\t1\t9\t9\tAAA\t-\t-\t0.06\nA\tx\t1\t9\t9\tCCC\tC\t0.1\t0.2\n")
    got = formats.read_predictions(spark, str(tmp_path / "p.tsv")).collect()
    assert [(r.peptide, r.core, r.percentile) for r in got] == [("AAA", None, 0.06)]


def test_topology_and_localization(spark, tmp_path):
    (tmp_path / "t.txt").write_text("ID   A\nFT   SIGNAL      1      24\nFT   TRANSMEM   30     50\nFT   TRANSMEM   60     80\n//\nID   B\n//\n")
    got = {r.protein_id: (r.signal.end if r.signal else None, len(r.tm)) for r in formats.read_topology(spark, str(tmp_path / "t.txt")).collect()}
    assert got == {"A": (24, 2), "B": (None, 0)}
    (tmp_path / "l.txt").write_text("SeqID\tLocalization\tScore\n# note\nA\tOuterMembrane\t9.52\nB  Outer membrane  8.1\nC\tOdd\t1\n")
    got = {(r.protein_id, r.label, r.score) for r in formats.read_localization(spark, str(tmp_path / "l.txt")).collect()}
    assert got == {("A", "OuterMembrane", 9.52), ("B", "Outer membrane", 8.1), ("C", "Odd", 1.0)}


@pytest.mark.parametrize(("match", "flagged"), [(0.0, False), (35.0, False), (36.0, False), (36.833, False), (37.0, True), (50.0, True)])
def test_allergen_edges(spark, match, flagged):
    score = one(spark, scoring.allergenicity(F.lit("A" * 60), F.lit(match)))
    assert score == pytest.approx(0.1 + (0.006 * match if match > 35 else 0)) and (score >= 0.321) == flagged


def test_binding_pole_is_null(spark):
    assert one(spark, scoring.binding_from_ic50(F.lit(10.0))) is None
    assert one(spark, scoring.binding_from_ic50(F.lit(100.0))) == 1.0
    assert one(spark, scoring.binding_from_ic50(F.lit(0.0))) == 1.0


def test_aggregation_of_peptides_matches_the_window_form(spark):
    seqs = ["IIIII", "IIIIIIAAAAA", "AC", "KKKKKKKK", "VVVVLLLLKKKIIIIIFF"]
    proteins = spark.createDataFrame([("p", i, s) for i, s in enumerate(seqs)], "proteome_id string, ord int, sequence string")
    windows = {r.ord: r.aggregation for r in residues.aggregation_windows(proteins).collect()}
    direct = {r.ord: r.a for r in proteins.select("ord", scoring.aggregation_share(F.col("sequence")).alias("a")).collect()}
    assert windows == pytest.approx(direct)


def test_covariance_needs_length_and_ignores_unknown_letters():
    assert covariance_score("A" * 36) is None
    assert covariance_score("ACDEFGHIKLMNPQRSTVWY" * 3) == covariance_score("ACDEFGHIKLXMNPQRSTVWY" * 3)
    assert 0 < covariance_score("ACDEFGHIKLMNPQRSTVWY" * 3) < 1


def test_isoelectric_point_orders_acid_and_base(spark):
    got = [r.pi for r in spark.createDataFrame([("DDDD",), ("KKKK",), ("",)], "s string").select(isoelectric_point("s").alias("pi")).collect()]
    assert got[0] < 5 < 9 < got[1] and got[2] is None


@pytest.mark.parametrize("k", range(0, 31, 5))
def test_cluster_threshold(spark, k):
    rows = [("p", 1, "A" * 100), ("p", 2, "A" * (100 - k) + "C" * k), ("p", 3, "A" * 100), ("p", 4, "WWW")]
    out = cluster.greedy_clusters(spark.createDataFrame(rows, "proteome_id string, ord int, sequence string"), 0.8, 5)
    got = {r.ord: r.rep_ord for r in out.collect()}
    assert got == {1: 1, 2: 1 if matching_ratio(rows[0][2], rows[1][2]) >= 0.8 else 2, 3: 1, 4: 4}


def _greedy(sequences, word, threshold=0.8):
    """The sequential rule: the first seed that shares a word and is alike, else a new seed."""
    seeds, rep = [], {}
    for o, s in sequences:
        words = {s[i : i + word] for i in range(len(s) - word + 1)}
        same = [q for q, t in sequences if t == s and q < o]
        near = [q for q, t in seeds if any(w in t for w in words) and min(len(s), len(t)) >= threshold * max(len(s), len(t)) and matching_ratio(t, s) >= threshold]
        rep[o] = rep[same[0]] if same else near[0] if near else o
        if rep[o] == o:
            seeds.append((o, s))
    return rep


def test_clusters_equal_the_sequential_rule_for_scattered_differences(spark, monkeypatch):
    monkeypatch.setattr(cluster, "FIRST_LEADERS", 2)  # several rounds
    rng = random.Random(6)
    letters = "ACDEFGHIKLMNPQRSTVWY"
    sequences = []
    for _ in range(4):
        base = "".join(rng.choice(letters) for _ in range(120))
        sequences.append(base)
        # differences 10 residues apart: 90 % identity without a common word of 24
        sequences.append("".join("W" if i % 10 == 5 else c for i, c in enumerate(base)))
        sequences += ["".join(rng.choice(letters) if rng.random() < r else c for c in base) for r in (0.05, 0.1, 0.15, 0.2, 0.25)]
        sequences += [base[:20], base[:19] + "W", base[:4]]
    rng.shuffle(sequences)
    rows = list(enumerate(sequences))
    frame = spark.createDataFrame([("p", *r) for r in rows], "proteome_id string, ord int, sequence string")
    got = {r.ord: r.rep_ord for r in cluster.greedy_clusters(frame).collect()}
    assert got == _greedy(rows, 5)
    assert len(set(got.values())) < len(sequences) - 8


def test_clusters_of_the_queries_take_whole_sequences(spark, data):
    from sieveline.plans import views
    from sieveline.plans.operations import QUERIES

    assert QUERIES["c24_greedy_cluster"](spark, data).count() == views.proteins(spark, data).count()


def test_overlap_ignores_unselected_rows(spark):
    rows = [("r", "b1", "BCELL_LINEAR", "DEFG", True), ("r", "t1", "CTL", "ACDEFGHIK", None), ("r", "b2", "BCELL_LINEAR", "CDEF", False), ("r", "b3", "BCELL_LINEAR", "ZZZZ", True)]
    found = epitopes.bt_overlap(spark.createDataFrame(rows, "run_id string, id string, type string, sequence string, selected boolean"))
    assert [tuple(r) for r in found.collect()] == [("r", "DEFG", "ACDEFGHIK", "DEFG", 1, 1)]


def test_construct_is_the_same_for_any_order_and_partitioning(spark):
    kinds = ["CTL"] * 5 + ["HTL"] * 3 + ["BCELL_LINEAR"] * 6
    rows = [("r", f"e{i:02d}", k, "ACDEFGHIK"[i % 5 :] + "WY"[i % 2], f"P{i % 4}", i, "A", float(i % 7) if i % 6 else None, i / 20, None, None, None) for i, k in enumerate(kinds)]
    schema = "run_id string, id string, type string, sequence string, accession string, start int, allele string, percentile double, antigenicity double, allergen_safety double, toxin_safety double, selected boolean"
    made = set()
    for parts, order in ((1, rows), (7, rows[::-1])):
        frame = spark.createDataFrame(order, schema).repartition(parts)
        made.add(epitopes.assemble_construct(epitopes.select_for_construct(frame)).first()["construct"])
    assert len(made) == 1 and made.pop().startswith("EAAAK")


def test_contacts_match_brute_force(spark):
    import random

    rng = random.Random(3)
    atoms = [("s", i, "A", rng.uniform(0, 30), rng.uniform(0, 30), rng.uniform(-9, 9)) for i in range(80)]
    frame = spark.createDataFrame(atoms, "structure_id string, res_idx int, aa string, x double, y double, z double")
    got = {(r.i, r.j) for r in structure.ca_contacts(frame).collect()}
    near = lambda a, b: sum((p - q) ** 2 for p, q in zip(a[3:], b[3:], strict=True)) <= 64
    assert got == {(a[1], b[1]) for a in atoms for b in atoms if b[1] - a[1] > 2 and near(a, b)}


def test_progress_never_takes_back_a_success(spark):
    rows = [(1, 1, "step_started", 1, 1, None, "2024-01-01 00:00:00"), (2, 1, "step_completed", 1, 1, None, "2024-01-01 00:00:01"), (3, 1, "step_progress", 1, 1, 50.0, "2024-01-01 00:00:02")]
    frame = spark.createDataFrame(rows, "id int, job_id int, type string, phase int, step int, percent double, ts string").withColumns({"ts": F.to_timestamp("ts"), "duration": F.lit(None).cast("int"), "error": F.lit(None).cast("string")})
    assert [(r.status, r.percent) for r in runs.step_state(frame).collect()] == [("success", 100)]
    state = None
    for _, _, kind, _, _, percent, _ in rows:
        state = apply_event(state, kind, percent)
    assert state == ("success", 100, None, None)


def test_scope_aliases(spark):
    genes = spark.createDataFrame([("Bacillus subtilis",), ("Escherichia coli",)], "organism string")
    assert proteome.essential_scope(genes, "All", {"all": None}).count() == 2
    assert proteome.essential_scope(genes, "coli", {"all": None}).count() == 1


def test_jobs_from_a_sql_table(spark):
    from sieveline.sources import formats

    url = "jdbc:derby:memory:jobs;create=true"
    rows = [(1, '{"name": "a"}'), (2, '{"n": 2}'), (30, "{}"), *((i, '{"name": "x"}') for i in range(40, 90))]
    spark.createDataFrame(rows, "id long, document string").coalesce(1).write.format("jdbc").options(url=url, dbtable="jobs", driver="org.apache.derby.jdbc.EmbeddedDriver", createTableColumnTypes="document VARCHAR(2000)").save()
    got = formats.read_jobs_jdbc(spark, url, "jobs", "name string", rows_a_partition=10)
    assert got.rdd.getNumPartitions() == 6
    assert sorted((r.id, r.name) for r in got.collect()) == [(1, "a"), (2, None), (30, None), *((i, "x") for i in range(40, 90))]
    assert "PushedFilters: [*IsNotNull(id), *GreaterThan(id,50)]" in got.filter("id > 50")._jdf.queryExecution().toString()
    spark.createDataFrame([], "id long, document string").write.format("jdbc").options(url=url, dbtable="no_jobs", createTableColumnTypes="document VARCHAR(9)").save()
    assert formats.read_jobs_jdbc(spark, url, "no_jobs", "name string").count() == 0


def test_numbers_in_ranges_equal_a_window(spark):
    from sieveline.sources.scratch import numbered

    rng = random.Random(4)
    rows = [("a" if rng.random() < 0.7 else rng.choice(["b", "c", None]), i) for i in range(2000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, id int").repartition(7)
    out = numbered(frame, "g", "id", "#")
    got = sorted(((r.g or "", r.id, r["#"]) for r in out.collect()))
    expected = []
    for g in ("a", "b", "c", None):
        expected += [(g or "", i, n) for n, i in enumerate(sorted(i for h, i in rows if h == g), 1)]
    assert got == sorted(expected)


def test_score_store_scores_once_and_lets_scores_expire(spark, tmp_path):
    from datetime import datetime, timedelta

    from sieveline.sources.store import ScoreStore

    day = lambda n: datetime(2024, 1, n)
    scores = ScoreStore(spark, "scores_of_a_test", f"file://{tmp_path}/store", 8, timedelta(days=5))
    first = spark.createDataFrame([(1, "AAA"), (2, "AAA"), (3, "C"), (4, None)], "ord int, sequence string")
    more = first.unionByName(spark.createDataFrame([(5, "WW")], "ord int, sequence string"))
    n = F.length("sequence")
    shown = lambda df: sorted((r.ord, r.score, r.scored_at and r.scored_at.day) for r in df.collect())
    assert shown(scores.update(first, n, day(1))) == [(1, 3.0, 1), (2, 3.0, 1), (3, 1.0, 1), (4, None, None)]
    assert {r.sequence for r in scores.missing(more, day(2)).collect()} == {"WW"}
    assert shown(scores.update(more, -n, day(3))) == [(1, 3.0, 1), (2, 3.0, 1), (3, 1.0, 1), (4, None, None), (5, -2.0, 3)]
    assert scores.missing(more, day(4)).count() == 0
    assert shown(scores.update(more, n * 10, day(7))) == [(1, 30.0, 7), (2, 30.0, 7), (3, 10.0, 7), (4, None, None), (5, -2.0, 3)]
    again = ScoreStore(spark, "scores_under_another_name", f"file://{tmp_path}/store", 8)
    assert again.scores(day(20)).count() == 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    plan = scores.missing(more, day(8))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.rindex("Exchange") < plan.index("ExistingRDD") < plan.index("FileScan") < plan.index("SelectedBucketsCount: 8")  # only new sequences move


def test_job_state_of_the_stream_goes_when_the_job_is_done(spark, tmp_path):
    from sieveline.streaming import events as streams

    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    at, out = f"file://{tmp_path}/in", []
    put = lambda *rows: spark.createDataFrame(list(rows), "id int, job_id int, type string, phase int, step int, percent double, second int").selectExpr(
        "id", "job_id", "type", "phase", "step", "percent", "timestamp_seconds(second) AS ts").write.mode("append").json(at)
    keep = lambda batch, n: out.extend((n, *r[:5]) for r in batch.collect())

    def run():
        state = streams.job_state(streams.read_events(spark, at, "json"), finished_ms=0)
        state.writeStream.foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/at").outputMode("update").trigger(availableNow=True).start().awaitTermination()

    put((1, 1, "step_started", 1, 2, None, 1), (2, 1, "step_progress", 1, 2, 40.0, 2), (3, 2, "step_failed", 3, None, None, 3), (4, 1, "note", None, None, None, 4))
    run()
    assert sorted(out, key=str) == [(0, 1, 1, 2, "running", 40), (0, 1, None, None, None, None), (0, 2, 3, 1, "failed", None), (0, 2, None, None, "paused", None)]
    out.clear()
    put((5, 1, "step_progress", 1, 2, None, 5), (6, 1, "pipeline_completed", None, None, None, 6), (7, 2, "pipeline_resumed", None, None, None, 7))
    run()
    assert sorted(out, key=str) == [(1, 1, 1, 2, "running", 40), (1, 1, None, None, "completed", 100), (1, 2, None, None, "running", None)]
    out.clear()
    put((8, 3, "note", None, None, None, 8))  # the timer of job 1 goes off
    run()
    put((9, 1, "step_progress", 1, 2, None, 9), (10, 2, "step_progress", 3, 1, None, 10))
    out.clear()
    run()
    got = sorted(out, key=str)
    assert [r[1:] for r in got] == [(1, 1, 2, "running", 10), (1, None, None, None, None), (2, 3, 1, "running", 10), (2, None, None, "running", None)]


def test_percent_and_messages_of_events(spark):
    fold = lambda *events: None if not events else apply_event(fold(*events[:-1]), *events[-1])
    assert fold(("step_progress", None)) == ("running", 10, None, None)
    assert fold(("step_started", None), ("step_progress", None)) == ("running", 5, None, None)
    assert fold(("step_progress", 250.0), ("step_progress", None)) == ("running", 100, None, None)
    assert fold(("step_completed", None, 7.0), ("step_failed", None), ("step_progress", None)) == ("running", 100, 7, "Unknown step failure")
    rows = [("step_completed", 2, 3, "blast", None, None, 9), ("step_completed", 2, 3, None, None, None, 0), ("step_failed", 2, 3, "", None, "", None), ("step_failed", None, 3, None, "why", None, None), ("odd", 1, 1, None, None, None, None)]
    frame = spark.createDataFrame(rows, "type string, phase int, step int, tool string, message string, error string, duration int")
    assert [r[0] for r in frame.select(runs.activity_message()).collect()] == ["Step 2.3 completed · blast · 9s", "Step 2.3 completed", "Step 2.3 failed: unknown error", "why", "odd"]


def test_contact_counts_equal_the_pairs(spark):
    from sieveline.operators import structure

    proteins = spark.createDataFrame([("p", 1, "AILVXFMWPKAAAAAAAA"), ("p", 2, "KKKK"), ("p", 3, ""), ("p", 4, "A")], "proteome_id string, ord long, sequence string")
    pairs = {(r.ord): r.n for r in structure.inferred_contacts(proteins).groupBy("ord").count().withColumnRenamed("count", "n").collect()}
    counts = {r.ord: r.local + r.hydrophobic for r in structure.inferred_contact_counts(proteins).collect()}
    assert {o: n for o, n in counts.items() if n} == pairs and counts[3] == counts[4] == 0


def test_instability_takes_its_table_from_the_caller(spark):
    from pyspark.sql import functions as F

    from sieveline.functions import scoring

    rows = spark.createDataFrame([("AAGA",), ("",), ("KK",)], "s string")
    got = [r.v for r in rows.select(scoring.instability(F.col("s"), {"AA": 1.0, "AG": -2.0, "GA": 4.0}).alias("v")).collect()]
    assert got == [7.5, None, 0.0]


def test_valid_sequence_takes_letters_one_by_one_and_whole_texts(spark, duck):
    from sieveline.operators import proteome
    from sieveline.plans.operations import ORACLE_SQL

    texts = ["wei\u00df", "\ufb01", "AC\u0085", "AC\u2028", "AC\n", "ac d\te", "\u0131\u017f", "", " ", None, "ACB"]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").select("doc_id", proteome.valid_sequence(F.col("text")).alias("valid"))
    values = ", ".join(f"({i}, {'NULL' if t is None else ' || '.join(f'chr({ord(c)})' for c in t) or repr(t)})" for i, t in enumerate(texts))
    sql = duck.execute(f"WITH documents(doc_id, text) AS (VALUES {values}) {ORACLE_SQL['p16_valid_sequence']}").fetchall()
    assert {r.doc_id: r.valid for r in made.collect()} == dict(sql)


def test_conformational_score_at_its_limit_and_half_way_roundings(spark):
    from sieveline.plans.screening import r6

    made = spark.createDataFrame([("p", 1, "NAAA"), ("p", 2, "N" * 11 + "A" * 53)], "proteome_id string, ord long, sequence string")
    domains = spark.createDataFrame([("p", 1)] * 5 + [("p", 2)] * 2, "proteome_id string, ord long")
    got = {r.ord: (r.is_epitope, r.score) for r in residues.conformational(made, None, domains).withColumn("score", r6("score")).collect()}
    assert got == {1: (True, 0.4), 2: (False, 0.210313)}  # as DuckDB has 0.7 * 0.25 + 0.045 * 5 and round(0.7 * 0.171875 + 0.045 * 2, 6)


def test_word_rows_of_empty_short_and_null_sequences_over_many_batches(spark, monkeypatch):
    from sieveline.functions import helpers

    monkeypatch.setattr(helpers, "WORD_ROWS", 7)
    texts = ["ACDEFGHIKL", "", None, "ACD", "ACDE", "A" * 40]
    made = spark.createDataFrame(list(enumerate(texts)), "ord long, sequence string")
    got = sorted((r.ord, r.start, r.peptide) for r in helpers.word_rows(made, 4).collect())
    assert got == sorted((i, k + 1, t[k : k + 4]) for i, t in enumerate(texts) for k in range(len(t or "") - 3))


def test_digits_are_those_of_the_hash_and_the_lowest_words_stay(spark, data, monkeypatch):
    import hashlib

    import numpy as np

    from sieveline.functions import helpers
    from sieveline.plans import views
    from sieveline.plans.operations import QUERIES

    letters = np.random.default_rng(4).integers(65, 91, (300, 9)).astype(np.uint8)
    of = lambda word, key: int(hashlib.md5(word + key.encode()).hexdigest()[:4], 16)
    monkeypatch.setattr(helpers, "HASHED_ROWS", 64)
    for key in ("HLA-A*02:01", "", "x" * 46):
        assert helpers.md5_digits(letters, key.encode()).tolist() == [of(bytes(w), key) for w in letters]
    monkeypatch.setattr(helpers, "WORD_ROWS", 7)
    texts = ["ACDEFGHIKLMNPQRSTVWY", "", None, "ACD", "ACDE", "A" * 40, "ACDEF"]
    made = spark.createDataFrame(list(enumerate(texts)), "ord long, sequence string")
    every = {(i, k + 1, t[k : k + 4], key, of(t[k : k + 4].encode(), key)) for i, t in enumerate(texts) for k in range(len(t or "") - 3) for key in ("p", "q")}
    assert {tuple(r) for r in helpers.word_rows(made, 4, ("p", "q")).collect()} == every
    assert {tuple(r) for r in helpers.word_rows(made, 4, ("p", "q"), most=20000).collect()} == {r for r in every if r[4] <= 20000}
    best = {tuple(r) for r in helpers.word_rows(made, 4, ("p", "q"), best=2).collect()}
    assert best < every and all({r for r in every if r[0] == i and r[4] <= sorted(x[4] for x in every if x[0] == i)[1]} <= best for i in (0, 4, 5, 6))
    monkeypatch.undo()
    assert views.lowest_predictions(spark, data, 5).count() * 10 < views.predictions(spark, data).count()
    for name in ("c9_score_epitopes", "a13_cytokine_counts"):  # the epitopes are made once
        assert "MapInArrow" not in QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_spread_over_tasks_and_read_once(spark, data):
    from sieveline.plans import views
    from sieveline.plans.operations import QUERIES

    assert views.words(spark, data).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert views.binders(spark, data).count() == views.predictions(spark, data).filter("percentile <= 2.0").count()
    for name in ("u2_append_epitopes", "u6_union_epitope_pool", "j2_conserved_epitopes", "j5_bt_overlap", "a15_overlap_summary"):
        assert QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 0, name


def test_tiles_runs_and_states_equal_the_row_forms_without_an_exchange(spark, monkeypatch):
    """Tiles, smoothed runs and region runs cut in a batch, against residues as rows with windows."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(residues, "BATCH_ROWS", 50)
    rng = random.Random(5)
    made = [("p", i, "".join(rng.choice("ACDEFGHIKLMNPQRSTVWYGPSDNKE") for _ in range(n))) for i, n in enumerate([1, 3, 7, 8, 15, 16, 17, 24, 40, *[200] * 30])]
    p = spark.createDataFrame([*made, ("p", 99, ""), ("p", 100, None)], "proteome_id string, ord long, sequence string")
    same = lambda a, b: sorted(map(tuple, a.select(sorted(a.columns)).collect())) == sorted(map(tuple, b.select(sorted(a.columns)).collect()))
    res = residues.residues(p)
    smooth = residues.smooth_scale(res)
    fragments = residues.linear_fragments(p).join(p.select("proteome_id", "ord", "sequence", F.length("sequence").alias("n")), ["proteome_id", "ord"])
    tiles = residues.tile_windows(fragments, keep=("sequence", "score")).groupBy("proteome_id", "ord", "w_start", "w_end").agg(F.max("score").alias("score"), F.first("sequence").alias("s"))
    tiles = tiles.select("proteome_id", "ord", "w_start", "w_end", F.substring("s", F.col("w_start"), F.col("w_end") - F.col("w_start") + 1).alias("sequence"), "score")
    states = residues.secondary_states(res).filter(F.col("state").isin("H", "E"))
    states = states.withColumn("proteome_id", F.concat("proteome_id", "state"))
    regions = residues.runs(states).filter("length >= 3").select(F.substring("proteome_id", 1, 1).alias("proteome_id"), "ord", F.substring("proteome_id", 2, 1).alias("state"), "start", "end", "length")
    new = [residues.linear_epitopes(p), residues.smooth_runs(p, 0.55), residues.smooth_tiles(p, 0.55), residues.region_runs(p)]
    old = [tiles, residues.runs(smooth.filter("smoothed >= 0.55")), residues.tile_windows(residues.runs(smooth.filter("smoothed >= 0.55"), F.max("n").alias("n"))), regions]
    for a, b in zip(new, old, strict=True):
        assert a.count() > 20 and same(a, b)
        assert "Exchange" not in a._jdf.queryExecution().executedPlan().toString()


def test_fold_of_a_job_asks_the_store_twice_a_trigger():
    from datetime import datetime

    from pyspark.sql import Row

    from sieveline.streaming import events as streams

    calls = []

    class Value:
        state = None

        def get(self):
            calls.append("get")
            return self.state

        def update(self, state):
            calls.append("update")
            self.state = state

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return Value()

    fold = streams.JobFold(streams.FINISHED, streams.FORGOTTEN)
    fold.init(Handle())
    event = lambda i, kind, step=None, **more: Row(**{"id": i, "ts": datetime(2024, 1, 1, 0, 0, i), "type": kind, "phase": 1, "step": step, "percent": None, "duration": None, "error": None, "funnel": None} | more)  # noqa: E731, E501
    rows = [event(i, "step_started", i) for i in range(40, 0, -1)] + [event(50, "filter_applied", funnel=[Row(stage="input", n=3)])]
    first = [tuple(r) for r in fold.handleInputRows((7,), iter(rows), None)]
    assert first == [(7, 1, i, "running", 0, None, None, None) for i in range(1, 41)] + [(7, None, None, None, None, None, None, [{"stage": "input", "n": 3}])]
    second = [tuple(r) for r in fold.handleInputRows((7,), iter([event(52, "step_failed", 2, error="x"), event(51, "step_completed", 2, duration=4.0)]), None)]
    assert second == [(7, 1, 2, "failed", 100, 4, "x", None), (7, None, None, "paused", None, None, "x", [{"stage": "input", "n": 3}])]
    assert calls == ["get", "update"] * 2
