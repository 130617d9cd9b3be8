"""Queries of the run, structure, format and streaming operators, with DuckDB SQL of the same result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions import scales as S
from sieveline.functions import scoring
from sieveline.operators import cluster, epitopes, proteome, runs, structure
from sieveline.sources import formats
from sieveline.sources.scratch import scratch_path
from sieveline.streaming import events as streams

from . import views as V
from .screening import _CONSTRUCT, _STATE, ORACLE_SQL, QUERIES, query, r6

# --- structures -------------------------------------------------------------------------------------

_CONTACTS = f"""{V.ATOMS}, contacts AS (SELECT a.structure_id, a.res_idx AS i, b.res_idx AS j, a.aa AS aa_i, b.aa AS aa_j,
  pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) AS d2 FROM atoms a JOIN atoms b ON a.structure_id = b.structure_id AND b.res_idx - a.res_idx > 2
  WHERE pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= 64), paired AS (SELECT *, least(aa_i, aa_j) || greatest(aa_i, aa_j) AS pair FROM contacts)"""


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.ca_contacts(V.atoms(spark, sf_dir))


@query("j7_ca_contacts", f"WITH {_CONTACTS} SELECT structure_id, i, j, aa_i, aa_j, round(d2, 4) AS d2 FROM contacts")
def j7(spark, sf_dir):
    return _contacts(spark, sf_dir).withColumn("d2", F.round("d2", 4))


def _pair_case(values: dict[str, float], default: float) -> str:
    return "CASE pair " + " ".join(f"WHEN '{k}' THEN {v}::double" for k, v in values.items()) + f" ELSE {default}::double END"


@query("a18_contact_quality", f"""WITH {_CONTACTS}, e AS (SELECT structure_id, least(1.0 / ({_pair_case(S.CONTACT_EXPECTED, 1.0)}), {_pair_case(S.CONTACT_EXPECTED, 1.0)}, 1.0) AS ratio FROM paired),
s AS (SELECT structure_id, count(*) AS contacts, sum(CASE WHEN ratio < 0.6 THEN 1.0 - ratio ELSE 0 END) AS bad, sum(CASE WHEN ratio < 0.6 THEN 0 ELSE ratio END) AS good FROM e GROUP BY 1)
SELECT structure_id, contacts, round(bad, 6) AS bad, round(good, 6) AS good, round((contacts - bad) / contacts * 100, 6) AS quality FROM s""")
def a18(spark, sf_dir):
    out = structure.contact_quality(_contacts(spark, sf_dir))
    return out.select("structure_id", "contacts", *[r6(c).alias(c) for c in ("bad", "good", "quality")])


@query("a19_contact_energy", f"""WITH {_CONTACTS}, e AS (SELECT structure_id, {_pair_case(S.CONTACT_ENERGY, 0.0)} AS e FROM paired),
s AS (SELECT structure_id, avg(e) AS energy, count_if(e > 1.0) AS violations, count(*) AS pairs FROM e GROUP BY 1)
SELECT structure_id, round(energy, 6) AS energy, violations, pairs, round((energy + 0.5) / 0.3, 6) AS z_score, (energy + 0.5) / 0.3 BETWEEN -4 AND 3 AND violations < 0.3 * pairs AS native_like FROM s""")
def a19(spark, sf_dir):
    out = structure.contact_energy(_contacts(spark, sf_dir))
    return out.withColumns({"energy": r6("energy"), "z_score": r6("z_score")})


@query("a25_coordinate_summary", f"WITH {_CONTACTS} SELECT (SELECT count(DISTINCT structure_id) FROM atoms) AS structures, (SELECT count(*) FROM atoms) AS residues, (SELECT count(DISTINCT structure_id) - count(DISTINCT CASE WHEN structure_id % 5 <> 0 THEN structure_id END) FROM atoms) AS failures, (SELECT count(DISTINCT res_idx % 7) FROM atoms) AS sources, count(*) AS contacts, count(DISTINCT structure_id) AS with_contacts FROM contacts")
def a25(spark, sf_dir):
    atoms = V.atoms(spark, sf_dir).withColumns({"source": F.col("res_idx") % 7, "x": F.when(F.col("structure_id") % 5 != 0, F.col("x"))})
    return structure.coordinate_summary(atoms, _contacts(spark, sf_dir))


_ANGLES = f"{V.ATOMS}, angles AS (SELECT structure_id, res_idx, aa, x * 6 AS phi, y * 6 AS psi FROM atoms)"
_FAV = "CASE WHEN kind = 'gly' THEN phi BETWEEN -120 AND -30 AND psi BETWEEN -70 AND 30 WHEN kind = 'pre' THEN phi BETWEEN -90 AND -30 AND psi BETWEEN -80 AND 20 ELSE phi BETWEEN -90 AND -30 AND psi BETWEEN -70 AND 30 END"
_ALL = "CASE WHEN kind = 'gly' THEN phi BETWEEN -180 AND 180 AND psi BETWEEN -180 AND 180 WHEN kind = 'pro' THEN phi BETWEEN -90 AND -30 AND psi BETWEEN -90 AND 30 WHEN kind = 'pre' THEN phi BETWEEN -90 AND -30 AND psi BETWEEN -90 AND 40 ELSE phi BETWEEN -180 AND -30 AND psi BETWEEN -180 AND 30 END"


@query("a17_ramachandran_summary", f"""WITH {_ANGLES}, k AS (SELECT *, CASE WHEN aa = 'G' THEN 'gly' WHEN lead(aa) OVER (PARTITION BY structure_id ORDER BY res_idx) = 'P' THEN 'pre' WHEN aa = 'P' THEN 'pro' ELSE 'other' END AS kind FROM angles),
f AS (SELECT structure_id, {_FAV} AS f, {_ALL} AS a FROM k) SELECT structure_id, count(*) AS residues, count_if(f) AS favored, count_if(NOT f AND a) AS allowed, count_if(NOT f AND NOT a) AS outlier FROM f GROUP BY 1""")
def a17(spark, sf_dir):
    angles = V.atoms(spark, sf_dir).select("structure_id", "res_idx", "aa", (F.col("x") * 6).alias("phi"), (F.col("y") * 6).alias("psi"))
    return structure.ramachandran_summary(angles)


@query("a27_mean_confidence", "SELECT vec_id AS structure_id, round(list_avg(list_transform(embedding, lambda v: v::double)), 6) AS confidence FROM embeddings")
def a27(spark, sf_dir):
    rows = V.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("structure_id"), F.transform("embedding", lambda v: v.cast("double")).alias("confidences"), F.lit(None).cast("double").alias("global_metric"))
    return structure.mean_confidence(rows).withColumn("confidence", r6("confidence"))


_PROFILE = f"{_CONSTRUCT}, proteins2 AS (SELECT run_id AS proteome_id, 0 AS ord, construct AS sequence FROM constructs)"


def _constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = epitopes.assemble_construct(epitopes.select_for_construct(V.epitopes(spark, sf_dir)))
    return built.select(F.col("run_id").alias("proteome_id"), F.lit(0).alias("ord"), F.col("construct").alias("sequence"))


_ON_CONSTRUCTS = "".join((f"{_PROFILE}", ", ", _STATE[_STATE.index("scale(") :].replace("FROM proteins", "FROM proteins2")))
_PAIRS = f"""WITH {_ON_CONSTRUCTS}, od AS (SELECT proteome_id, ord, pos, n, aa, avg((state IN ('H', 'E'))::int) OVER (PARTITION BY proteome_id, ord ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS o FROM st),
pr AS (SELECT a.proteome_id, a.ord, a.pos AS i, b.pos AS j, round(a.o + b.o + CASE WHEN b.pos <= a.pos + 40 THEN 4.0 ELSE 0 END, 3) AS score FROM od a JOIN od b ON a.proteome_id = b.proteome_id AND b.pos BETWEEN a.pos + 10 AND a.pos + 79 WHERE a.aa <> 'C' AND b.aa <> 'C')
SELECT proteome_id, ord, rank, i, j, score FROM (SELECT *, row_number() OVER (PARTITION BY proteome_id ORDER BY score DESC, i, j) AS rank FROM pr) WHERE rank <= 8"""


@query("j8_disulfide_pairs", _PAIRS)
def j8(spark, sf_dir):
    return structure.disulfide_pairs(_constructs(spark, sf_dir))


_PLACES = f"{V.ATOMS}, places AS (SELECT res_idx + 1 AS pos, min(x) AS x, min(y) AS y, min(z) AS z FROM atoms GROUP BY 1)"
_BOOST = "sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))"


@query("j8_disulfide_places", _PAIRS.replace("pr AS (", f"{_PLACES}, oc AS (SELECT od.*, x, y, z FROM od LEFT JOIN places USING (pos)), pr AS (").replace("THEN 4.0 ELSE 0 END, 3)", f"THEN 4.0 ELSE 0 END + CASE WHEN {_BOOST} BETWEEN 3 AND 9 THEN 1.0 - abs({_BOOST} - 6.0) / 3.0 ELSE 0 END, 3)").replace("FROM od a JOIN od b", "FROM oc a JOIN oc b"))
def j8_places(spark, sf_dir):
    """With coordinates: residues at a fitting distance score more."""
    built = _constructs(spark, sf_dir)
    by_place = V.atoms(spark, sf_dir).groupBy((F.col("res_idx") + 1).alias("pos")).agg(*[F.min(c).alias(c) for c in "xyz"])
    sized = built.filter("sequence <> ''").select("proteome_id", "ord", F.explode(F.sequence(F.lit(1), F.length("sequence"))).alias("pos"))
    return structure.disulfide_pairs(built, places=sized.join(by_place, "pos"))


@query("k6_disulfide_top8", _PAIRS.replace("SELECT proteome_id, ord, rank, i, j, score FROM (", "SELECT proteome_id, rank, i, j, score FROM ("))
def k6(spark, sf_dir):
    return structure.disulfide_pairs(_constructs(spark, sf_dir)).select("proteome_id", "rank", "i", "j", "score")


_CORE = "aa IN ('A', 'I', 'L', 'V', 'F', 'M', 'W', 'P')"
_LETTERS = """letters AS (SELECT proteome_id, ord, unnest(range(1, length(sequence) + 1)) AS pos, unnest(string_split(sequence, '')) AS aa FROM {source} WHERE sequence <> '')"""


@query("c22_inferred_contacts", f"""WITH {V.PROTEINS}, {_LETTERS.format(source='proteins')}, h AS (SELECT proteome_id, ord, count(*) OVER (PARTITION BY proteome_id, ord ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND 6 PRECEDING) AS n FROM letters WHERE {_CORE}),
s AS (SELECT proteome_id, ord, sum(n)::bigint AS hydrophobic FROM h GROUP BY ALL)
SELECT p.proteome_id, p.ord, (greatest(length(sequence) - 3, 0) + greatest(length(sequence) - 4, 0))::bigint AS local, coalesce(hydrophobic, 0) AS hydrophobic FROM proteins p LEFT JOIN s ON p.proteome_id = s.proteome_id AND p.ord = s.ord""")
def c22(spark, sf_dir):
    return structure.inferred_contact_counts(V.proteins(spark, sf_dir))


@query("c22_construct_contacts", f"""WITH {_PROFILE}, {_LETTERS.format(source='proteins2')}
SELECT x.proteome_id, x.ord, x.pos AS i, y.pos AS j, x.aa AS aa_i, y.aa AS aa_j FROM letters x JOIN letters y ON x.proteome_id = y.proteome_id AND (y.pos IN (x.pos + 3, x.pos + 4) OR (y.pos > x.pos + 5 AND {_CORE.replace('aa', 'x.aa')} AND {_CORE.replace('aa', 'y.aa')}))""")
def c22_construct(spark, sf_dir):
    return structure.inferred_contacts(_constructs(spark, sf_dir))


_DNA = "dna AS (SELECT doc_id AS id, regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACGT]', '', 'g') AS dna FROM documents)"
_SITES = "sites(enzyme, site, enzyme_ord) AS (VALUES " + ", ".join(f"('{e}', '{s}', {i})" for i, (e, s) in enumerate(S.ENZYMES)) + ")"
_CUTS = f"{_DNA}, {_SITES}, cuts AS (SELECT id, enzyme, enzyme_ord, position FROM (SELECT id, enzyme, enzyme_ord, site, dna, unnest(range(0, length(dna) - length(site) + 1)) AS position FROM dna, sites WHERE contains(dna, site)) WHERE substr(dna, position + 1, length(site)) = site)"


def _dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace(letters, "[^ACGT]", "").alias("dna"))


@query("j12_restriction_sites", f"WITH {_CUTS} SELECT id, enzyme, enzyme_ord, position FROM cuts")
def j12(spark, sf_dir):
    return structure.restriction_sites(_dna(spark, sf_dir))


@query("j14_usable_enzymes", f"""WITH {_CUTS}, v AS (SELECT id AS vector_id, enzyme, enzyme_ord, count(*) AS n FROM cuts GROUP BY ALL), p AS (SELECT id AS vector_id, id + 1 AS insert_id FROM dna),
f AS (SELECT p.vector_id, p.insert_id, v.enzyme, enzyme_ord, n FROM p JOIN v USING (vector_id) WHERE NOT EXISTS (SELECT 1 FROM cuts c WHERE c.id = p.insert_id AND c.enzyme = v.enzyme)),
m AS (SELECT *, count_if(n >= 2) OVER (PARTITION BY vector_id, insert_id) AS many FROM f)
SELECT vector_id, insert_id, rank, enzyme, n FROM (SELECT *, row_number() OVER (PARTITION BY vector_id, insert_id ORDER BY enzyme_ord) AS rank FROM m WHERE CASE WHEN many >= 2 THEN n >= 2 ELSE n = 1 END) WHERE rank <= 2""")
def j14(spark, sf_dir):
    dna = _dna(spark, sf_dir)
    pairs = dna.select(F.col("id").alias("vector_id"), (F.col("id") + 1).alias("insert_id"))
    return structure.usable_enzymes(dna, dna, pairs)


@query("c20_transcript_profile", f"""WITH {_DNA}, c AS (SELECT *, [substr(dna, i * 3 + 1, 3) for i in range(0, length(dna) // 3)] AS codons FROM dna)
SELECT id, length(dna) AS bp, len(codons) AS n_codons, round(coalesce((length(dna) - length(translate(dna, 'GC', ''))) * 100.0 / nullif(length(dna), 0), 0), 6) AS gc,
len(list_filter(codons, lambda x: x IN ('AGG', 'AGA', 'CGG', 'CGA'))) AS n_rare FROM c""")
def c20(spark, sf_dir):
    dna = F.col("dna")
    return _dna(spark, sf_dir).select("id", F.length(dna).alias("bp"), F.size(scoring.codons(dna)).alias("n_codons"), r6(scoring.gc_percent(dna)).alias("gc"), F.size(scoring.rare_codons(dna)).alias("n_rare"))


@query("c20_transcript_annotation", f"""WITH {_CUTS}, c AS (SELECT *, [substr(dna, i * 3 + 1, 3) for i in range(0, length(dna) // 3)] AS codons FROM dna),
s AS (SELECT id, string_agg(enzyme || '@' || position, ',' ORDER BY enzyme_ord, position) AS sites FROM cuts GROUP BY id),
code(codon, aa) AS (SELECT substr('TCAG', i // 16 + 1, 1) || substr('TCAG', i // 4 % 4 + 1, 1) || substr('TCAG', i % 4 + 1, 1), substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', i + 1, 1) FROM range(64) t(i)),
m AS (SELECT map(list(codon), list(aa)) AS m FROM code)
SELECT c.id, coalesce(list_aggregate(list_transform(codons, lambda x: m[x]), 'string_agg', ''), '') AS protein,
CASE WHEN length(dna) >= 3 THEN round(0.3 + 0.4 * len(list_filter(codons, lambda x: regexp_matches(x, '^(GG.|GA.|GC[GCA]|CC.|CG[TC])$')))::double / len(codons), 6) ELSE 0.5 END AS adaptation,
array_to_string(list_filter(codons, lambda x: x IN ('AGG', 'AGA', 'CGG', 'CGA'))[1:10], ',') AS rare, coalesce(sites, '') AS sites FROM c CROSS JOIN m LEFT JOIN s ON s.id = c.id""")
def c20_annotation(spark, sf_dir):
    """Protein, adaptation, the first ten rare codons and all enzyme sites of each transcript."""
    dna = _dna(spark, sf_dir)
    site = F.struct("enzyme_ord", "position", F.concat("enzyme", F.lit("@"), F.col("position").cast("string")).alias("name"))
    sites = structure.restriction_sites(dna).groupBy("id").agg(F.array_sort(F.collect_list(site)).alias("sites"))
    s = F.col("dna")
    return dna.join(sites, "id", "left").select(
        "id", scoring.translated(s).alias("protein"), r6(scoring.adaptation(s)).alias("adaptation"), F.array_join(F.slice(scoring.rare_codons(s), 1, 10), ",").alias("rare"),
        F.coalesce(F.array_join(F.transform("sites", lambda x: x["name"]), ","), F.lit("")).alias("sites"),
    )


@query("c21_global_identity")
def c21_global(spark, sf_dir):
    """Matching ratio of every protein and the next one of its proteome; SQL has no such alignment, the tests compare it with the slow form."""
    return cluster.identity_to_next(V.proteins(spark, sf_dir)).select("proteome_id", "ord", r6("identity").alias("identity"))


@query("c21_pairwise_identity", """WITH p AS (SELECT a.item_id, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)
SELECT item_id, round(list_sum([(substr(x, i, 1) = substr(y, i, 1))::int for i in range(1, least(length(x), length(y)) + 1)]) * 100.0 / least(length(x), length(y)), 6) AS identity FROM p""")
def c21(spark, sf_dir):
    b = V.table(spark, sf_dir, "benchmark")
    right = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    return b.join(right, "item_id").select("item_id", r6(scoring.positional_identity(F.col("text"), F.col("other"))).alias("identity"))


# --- runs -------------------------------------------------------------------------------------------


@query("a20_job_progress", f"""WITH {V.STEPS}, a AS (SELECT job_id, count(*) AS total, count_if(status = 'success') AS completed, min(CASE WHEN status <> 'success' THEN phase * 1000 + step END) AS nx FROM steps GROUP BY 1)
SELECT job_id, total, completed, round(completed * 100.0 / total, 6) AS percent, (nx // 1000)::int AS next_phase, (nx % 1000)::int AS next_step, (total - completed) * 9 AS seconds_left FROM a""")
def a20(spark, sf_dir):
    return runs.job_progress(V.steps(spark, sf_dir)).withColumn("percent", r6("percent"))


@query("w11_first_incomplete_step", f"WITH {V.STEPS} SELECT job_id, (min(phase * 1000 + step) // 1000)::int AS next_phase, (min(phase * 1000 + step) % 1000)::int AS next_step FROM steps WHERE status <> 'success' GROUP BY 1")
def w11(spark, sf_dir):
    return runs.job_progress(V.steps(spark, sf_dir)).filter("next_phase IS NOT NULL").select("job_id", "next_phase", "next_step")


@query("a21_phase_status", f"""WITH {V.STEPS} SELECT job_id, phase, CASE WHEN bool_and(status IN ('success', 'skipped')) THEN 'completed' WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'running') THEN 'running'
WHEN bool_or(status = 'paused') THEN 'paused' ELSE 'pending' END AS phase_status, round(sum(seconds), 2) AS seconds FROM steps GROUP BY 1, 2""")
def a21(spark, sf_dir):
    return runs.phase_status(V.steps(spark, sf_dir)).withColumn("seconds", F.round("seconds", 2))


_JOBS = "jobs AS (SELECT c_custkey AS job_id, c_name AS job_name, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'completed' WHEN 'BUILDING' THEN 'running' WHEN 'HOUSEHOLD' THEN 'failed' WHEN 'MACHINERY' THEN 'paused' ELSE 'pending' END AS status FROM customer)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("c_mktsegment")
    status = F.when(s == "AUTOMOBILE", "completed").when(s == "BUILDING", "running").when(s == "HOUSEHOLD", "failed").when(s == "MACHINERY", "paused").otherwise("pending")
    return V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_name").alias("job_name"), status.alias("status"))


@query("a22_job_status_counts", f"WITH {_JOBS} SELECT count(*) AS total, count_if(status = 'completed') AS completed, count_if(status = 'running') AS running, count_if(status IN ('failed', 'paused')) AS stopped FROM jobs")
def a22(spark, sf_dir):
    return runs.job_status_counts(_jobs(spark, sf_dir))


_FUNNEL = f"{V.STEPS}, fn AS (SELECT job_id, stage, count_if(status = 'success') AS n FROM steps GROUP BY 1, 2 HAVING count_if(status = 'success') > 0)"


@query("a7_stage_funnel", f"WITH {_FUNNEL} SELECT job_id, stage, n, stage = max(stage) OVER (PARTITION BY job_id) AS final FROM fn")
def a7_stage(spark, sf_dir):
    return runs.stage_funnel(V.steps(spark, sf_dir))


@query("u4_stage_union", f"WITH {_FUNNEL} SELECT stage, min(job_id) AS first_job, count(*) AS n_jobs FROM fn GROUP BY 1")
def u4(spark, sf_dir):
    return runs.stage_union(runs.stage_funnel(V.steps(spark, sf_dir)))


@query("j11_compare_runs", f"WITH {_FUNNEL}, {_JOBS}, s AS (SELECT DISTINCT stage FROM fn) SELECT j.job_id, s.stage, fn.n FROM jobs j CROSS JOIN s LEFT JOIN fn ON fn.job_id = j.job_id AND fn.stage = s.stage WHERE j.status = 'completed'")
def j11(spark, sf_dir):
    return runs.compare_runs(runs.stage_funnel(V.steps(spark, sf_dir)), _jobs(spark, sf_dir).filter("status = 'completed'"))


@query("j13_paper_reference_join", f"WITH {_FUNNEL}, ref(stage, published) AS (VALUES ('1-URGENT', 2106), ('2-HIGH', 2094), ('3-MEDIUM', 507)) SELECT job_id, stage, n, published FROM fn LEFT JOIN ref USING (stage)")
def j13(spark, sf_dir):
    published = spark.createDataFrame([("1-URGENT", 2106), ("2-HIGH", 2094), ("3-MEDIUM", 507)], "stage string, published int")
    return runs.stage_funnel(V.steps(spark, sf_dir)).join(F.broadcast(published), "stage", "left").select("job_id", "stage", "n", "published")


@query("a26_funnel_evidence", f"WITH {_FUNNEL}, b AS (SELECT job_id, stage, count(*) AS n_steps, bool_or(status = 'failed') AS failed FROM steps GROUP BY 1, 2) SELECT job_id, stage, CASE WHEN NOT failed THEN n END AS n, stage || ' · ' || CASE WHEN failed THEN 'unavailable' ELSE 'real' END || ' · ' || n_steps AS evidence FROM fn JOIN b USING (job_id, stage)")
def a26(spark, sf_dir):
    steps = V.steps(spark, sf_dir)
    return runs.funnel_evidence(runs.stage_funnel(steps), steps)


@query("u3_stage_fallback", "SELECT o_orderkey, job_id, priority FROM (SELECT o_orderkey, o_custkey AS job_id, substr(o_orderpriority, 1, 1)::int AS priority, max(substr(o_orderpriority, 1, 1)::int) OVER (PARTITION BY o_custkey) AS top FROM orders) WHERE priority = top")
def u3(spark, sf_dir):
    rows = V.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("job_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"))
    return runs.stage_fallback(rows).select("o_orderkey", "job_id", "priority")


@query("p18_provenance_status", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'given' WHEN event_type = 'error' THEN 'unavailable' WHEN value > 90 THEN 'cached-real' WHEN regexp_matches(lower(m), 'local|approximation|heuristic') THEN 'local-analysis' WHEN regexp_matches(lower(m), 'api|blast|service|remote') THEN 'real' ELSE 'unavailable' END AS status FROM (SELECT *, CASE event_type WHEN 'click' THEN 'Local scorer' WHEN 'view' THEN 'remote API' ELSE '' END AS m FROM events)")
def p18(spark, sf_dir):
    kind = F.col("event_type")
    method = F.when(kind == "click", "Local scorer").when(kind == "view", "remote API").otherwise("")
    status = runs.provenance_status(F.when(kind == "purchase", "given"), kind == "error", F.col("value") > 90, method)
    return V.table(spark, sf_dir, "events").select("event_id", status.alias("status"))


@query("p20_essential_scope", "SELECT p_partkey, p_name AS organism FROM part WHERE contains(p_name, 'ring')")
def p20(spark, sf_dir):
    genes = V.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("organism"))
    return proteome.essential_scope(genes, " Rings ", {"all": None, "rings": "ring"})


@query("s5_pick_reference_proteome", "SELECT s_suppkey AS taxon_id, 'UP' || min(p_partkey) AS proteome_id, count(*) AS protein_count FROM supplier JOIN part ON p_partkey % (SELECT max(s_suppkey) + 1 FROM supplier) = s_suppkey GROUP BY 1")
def s5(spark, sf_dir):
    top = V.table(spark, sf_dir, "supplier").agg((F.max("s_suppkey") + 1).alias("m"))
    p = V.table(spark, sf_dir, "part").join(F.broadcast(top)).withColumn("taxon_id", F.col("p_partkey") % F.col("m"))  # one row
    by = p.groupBy("taxon_id").agg(F.min("p_partkey").alias("low"), F.count("*").alias("protein_count"))
    meta = by.select("taxon_id", F.concat(F.lit("UP"), F.col("low").cast("string")).alias("proteome_id"), F.lit("Reference proteome").alias("proteome_type"), "protein_count")
    others = meta.withColumn("proteome_type", F.lit("Other proteome"))
    known = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("taxon_id"))
    return proteome.pick_reference_proteome(meta.unionByName(others)).join(known, "taxon_id", "left_semi")


# --- events -----------------------------------------------------------------------------------------

_KIND = """CASE WHEN type IN ('step_started', 'step_progress') THEN 'running' WHEN type IN ('step_completed', 'filter_applied', 'pipeline_completed') THEN 'success'
  WHEN type = 'step_failed' THEN 'error' WHEN type = 'pipeline_paused' THEN 'warning' ELSE 'info' END"""
_MESSAGE = """CASE type WHEN 'step_started' THEN format('Step {}.{} ({}) started', phase, step, coalesce(tool, 'tool')) WHEN 'step_progress' THEN format('Step {}.{} ({}) progressing', phase, step, coalesce(tool, 'tool'))
  WHEN 'step_completed' THEN format('Step {}.{} completed', phase, step) || coalesce(' · ' || tool, '') || CASE WHEN duration <> 0 THEN ' · ' || duration || 's' ELSE '' END
  WHEN 'step_failed' THEN format('Step {}.{} failed', phase, step) || coalesce(' · ' || tool, '') || ': ' || coalesce(error, 'unknown error')
  WHEN 'pipeline_paused' THEN 'Pipeline paused — ' || coalesce(message, 'step review required') WHEN 'pipeline_resumed' THEN 'Pipeline resumed — ' || coalesce(message, 'continuing')
  WHEN 'pipeline_completed' THEN 'Pipeline completed — all phases finished' WHEN 'filter_applied' THEN 'Filter applied — funnel counts updated' ELSE coalesce(message, type) END"""


@query("k3_activity_feed", f"WITH {V.EVENTS}, {_JOBS} SELECT id, ev.job_id, coalesce(job_name, ev.job_id::varchar) AS job_name, {_KIND} AS kind, {_MESSAGE} AS message, ts FROM (SELECT * FROM ev ORDER BY ts DESC, id DESC LIMIT 50) ev LEFT JOIN jobs ON ev.job_id = jobs.job_id")
def k3(spark, sf_dir):
    return runs.activity_feed(V.events(spark, sf_dir), _jobs(spark, sf_dir), 50)


@query("t5_activity_messages", f"WITH {V.EVENTS} SELECT {_KIND} AS kind, {_MESSAGE} AS message, count(*) AS n FROM ev GROUP BY 1, 2")
def t5_messages(spark, sf_dir):
    shown = V.events(spark, sf_dir).select(runs.activity_kind(F.col("type")).alias("kind"), runs.activity_message().alias("message"))
    return shown.groupBy("kind", "message").agg(F.count("*").alias("n"))


@query("k7_recent_events", f"WITH {V.EVENTS} SELECT id, job_id, type, rank FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, id DESC) AS rank FROM ev) WHERE rank <= 20")
def k7(spark, sf_dir):
    return runs.recent_events(V.events(spark, sf_dir), 20).select("id", "job_id", "type", "rank")


@query("t4_events_since", f"WITH {V.EVENTS}, c AS (SELECT job_id, min(id) + 200 AS cursor FROM ev GROUP BY 1), k AS (SELECT c.job_id, e.ts, e.id FROM c LEFT JOIN ev e ON e.job_id = c.job_id AND e.id = c.cursor) SELECT ev.id, ev.job_id, ev.type FROM ev JOIN k USING (job_id) WHERE k.ts IS NULL OR (ev.ts, ev.id) > (k.ts, k.id)")
def t4(spark, sf_dir):
    e = V.events(spark, sf_dir)
    cursors = e.groupBy("job_id").agg((F.min("id") + 200).alias("cursor"))
    return runs.events_since(e, cursors).select("id", "job_id", "type")


@query("t5_event_counts", f"WITH {V.EVENTS} SELECT {_KIND} AS kind, count(*) AS n FROM ev GROUP BY 1")
def t5(spark, sf_dir):
    return runs.event_counts(V.events(spark, sf_dir))


_FOLD = f"""WITH {V.EVENTS}, o AS (SELECT *, row_number() OVER (ORDER BY ts, id) AS o FROM ev),
e AS (SELECT *, last_value(CASE WHEN type <> 'step_progress' THEN type END IGNORE NULLS) OVER (PARTITION BY job_id, phase, step ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS settled
  FROM o WHERE starts_with(type, 'step_')),
p AS (SELECT *, CASE type WHEN 'step_started' THEN 0 WHEN 'step_completed' THEN 100 WHEN 'step_progress' THEN CASE WHEN percent IS NOT NULL THEN least(greatest(round(percent)::int, 5), 100) END END AS put
  FROM e WHERE type <> 'step_progress' OR settled IS DISTINCT FROM 'step_completed'),
a AS (SELECT job_id, phase, step, arg_max(type, o) AS last, arg_max(put, o) FILTER (put IS NOT NULL) AS put, max(o) FILTER (put IS NOT NULL) AS put_at, max(o) FILTER (type = 'step_progress') AS moved_at,
  arg_max(duration, o) FILTER (type = 'step_completed' AND duration IS NOT NULL) AS duration, arg_max(coalesce(error, 'Unknown step failure'), o) FILTER (type = 'step_failed') AS error FROM p GROUP BY 1, 2, 3)
SELECT job_id, phase, step, CASE last WHEN 'step_completed' THEN 'success' WHEN 'step_failed' THEN 'failed' ELSE 'running' END AS status,
  CASE WHEN moved_at > coalesce(put_at, 0) THEN greatest(coalesce(put, 10), 5) ELSE put END::int AS percent, duration, error, NULL AS funnel FROM a
UNION ALL SELECT job_id, NULL, NULL, CASE arg_max(type, o) FILTER (type IN ('step_failed', 'pipeline_paused', 'pipeline_resumed', 'pipeline_completed')) WHEN 'step_failed' THEN 'paused' WHEN 'pipeline_paused' THEN 'paused'
  WHEN 'pipeline_resumed' THEN 'running' WHEN 'pipeline_completed' THEN 'completed' END, CASE WHEN bool_or(type = 'pipeline_completed') THEN 100 END, NULL,
  arg_max(coalesce(error, 'Unknown step failure'), o) FILTER (type = 'step_failed'), arg_max(funnel, o) FILTER (funnel IS NOT NULL) FROM o GROUP BY job_id"""


def _funnel_text(state: DataFrame) -> DataFrame:
    return state.withColumn("funnel", F.array_join(F.transform("funnel", lambda s: F.concat(s["stage"], F.lit(":"), s["n"].cast("string"))), ","))


@query("t2_job_state", _FOLD)
def t2(spark, sf_dir):
    return _funnel_text(runs.job_state(V.events(spark, sf_dir)))


def _drained(stream, spark: SparkSession, name: str, schema: str, mode: str) -> DataFrame:
    """Runs a stream over all available input and returns what it appended to Parquet files."""
    out, at = scratch_path(spark, name), scratch_path(spark, f"{name}-offsets")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # state with a time to live asks for empty batches without end
    if mode == "append":
        running = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode(mode).trigger(availableNow=True).start()
    else:
        put = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)
        running = stream.writeStream.foreachBatch(put).option("checkpointLocation", at).outputMode(mode).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(schema).parquet(out)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events view laid down as files and read back as a stream."""
    path = scratch_path(spark, "event-files")
    V.events(spark, sf_dir).withColumns({"id": F.col("id").cast("long"), "job_id": F.col("job_id").cast("long")}).write.parquet(path)
    return streams.read_events(spark, path)


@query("t1_ingest_events", f"WITH {V.EVENTS} SELECT id, job_id, type, phase, step, percent, tool, message, error, duration FROM ev")
def t1(spark, sf_dir):
    rows = _drained(streams.deduplicated(_stream(spark, sf_dir)), spark, "ingested", streams.EVENT, "append")
    return rows.drop("ts", "funnel")


@query("t2_job_state_stream", _FOLD)
def t2_stream(spark, sf_dir):
    changed = _drained(streams.job_state(_stream(spark, sf_dir)), spark, "job-state", f"{streams.STATE}, batch long", "update")
    last = F.max_by(F.struct("status", "percent", "duration", "error", "funnel"), "batch")
    return _funnel_text(changed.groupBy("job_id", "phase", "step").agg(last.alias("s")).select("job_id", "phase", "step", "s.*"))


@query("t3_recent_events_state", f"WITH {V.EVENTS} SELECT id, job_id, type FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, id DESC) AS rank FROM ev) WHERE rank <= 20")
def t3(spark, sf_dir):
    shown = _drained(streams.recent_events(_stream(spark, sf_dir), 20), spark, "recent", f"{streams.RECENT}, batch long", "update")
    last = shown.groupBy("job_id").agg(F.max("batch").alias("batch"))
    return shown.join(last, ["job_id", "batch"]).select("id", "job_id", "type")


# --- formats: written from the tables and read back --------------------------------------------------


@query("s1_read_fasta", f"WITH {V.PROTEINS} SELECT accession, 'PROT' AS name, sequence, reviewed FROM proteins")
def s1(spark, sf_dir):
    path = scratch_path(spark, "fasta")
    header = F.concat(F.when(F.col("reviewed"), "sp|").otherwise("tr|"), F.col("accession"), F.lit("|PROT a protein"))
    formats.write_fasta(V.proteins(spark, sf_dir), path, header)
    return formats.read_fasta(spark, path).drop("proteome_id")


@query("s2_strict_fasta", f"WITH {V.PROTEINS} SELECT accession, length(sequence) AS n FROM proteins WHERE ord % 10 <> 0 AND sequence <> ''")
def s2(spark, sf_dir):
    path = scratch_path(spark, "fasta")
    header = F.when(F.col("ord") % 10 == 0, "plain header").otherwise(F.concat(F.lit("sp|"), F.col("accession"), F.lit("|PROT")))
    formats.write_fasta(V.proteins(spark, sf_dir), path, header)
    return formats.strict_fasta(formats.read_fasta(spark, path))[0].select("accession", F.length("sequence").alias("n"))


@query("s6_read_hits", f"WITH {V.HITS} SELECT query_id::varchar AS query_id, 'S' || subject_id AS accession, round(identity, 4) AS pident, round(bitscore, 4) AS bitscore FROM hits")
def s6(spark, sf_dir):
    path = scratch_path(spark, "hits")
    h = V.hits(spark, sf_dir)
    h.select(
        F.concat(F.col("query_id").cast("string"), F.lit("|q")), F.concat(F.lit("gb|S"), F.col("subject_id").cast("string")), F.lit("title"), "identity",
        F.pow(F.lit(10.0), -F.col("neg_log10_e")), "align_length", "bitscore",
    ).write.csv(path, sep="\t")
    back = formats.read_hits(spark, path, 7)
    return back.select("query_id", "accession", F.round("pident", 4).alias("pident"), F.round("bitscore", 4).alias("bitscore"))


@query("s7_read_predictions", f"WITH {V.EPITOPES} SELECT allele, ord::int AS seq_num, start, sequence AS peptide, round(percentile, 4) AS percentile FROM epitopes")
def s7(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    e = V.epitopes(spark, sf_dir)
    e.select("allele", F.col("ord").alias("seq_num"), "start", (F.col("start") + 8).alias("end"), F.length("sequence").alias("length"), F.col("sequence").alias("peptide"),
             F.lit("-").alias("core"), F.lit("-").alias("consensus_percentile_rank"), F.coalesce(F.col("percentile").cast("string"), F.lit("-")).alias("percentile_rank")).write.csv(path, sep="\t", header=True)
    return formats.read_predictions(spark, path).select("allele", "seq_num", "start", "peptide", F.round("percentile", 4).alias("percentile"))


@query("s8_remap_seq_num", "SELECT l_orderkey AS batch, l_orderkey * 5 + l_linenumber AS query_index, l_partkey FROM lineitem WHERE l_linenumber BETWEEN 1 AND 5")
def s8(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("seq_num"), "l_partkey")
    manifest = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch"), (F.col("o_orderkey") * 5).alias("offset"), F.lit(5).alias("batch_size"))
    return formats.remap_seq_num(rows, manifest).select("batch", "query_index", "l_partkey")


@query("s9_read_essential_annotation", "SELECT p_partkey AS gi, p_name AS product, p_brand AS organism FROM part WHERE contains(p_brand, 'Brand#1')")
def s9(spark, sf_dir):
    path = scratch_path(spark, "annotation")
    p = V.table(spark, sf_dir, "part")
    p.select(F.lit("DEG10"), F.lit("gene"), F.concat(F.lit("GI:"), F.col("p_partkey").cast("string")), F.lit("locus"), F.lit("x"), "p_name", F.lit("-"), F.lit("-"), "p_brand").write.csv(path, sep=";", quoteAll=True)
    return formats.read_essential_annotation(spark, path, "Brand#1").select("gi", "product", "organism")


@query("s10_read_localization", f"WITH {V.LOCALIZATIONS} SELECT accession AS protein_id, CASE WHEN label = 'Cell Wall' THEN 'CellWall' ELSE label END AS label, round(ord % 100 / 10.0, 2) AS score FROM localizations")
def s10(spark, sf_dir):
    path = scratch_path(spark, "localization")
    label = F.when(F.col("label") == "Cell Wall", "CellWall").otherwise(F.col("label"))
    lines = F.concat_ws("\t", "accession", label, F.format_number(F.col("ord") % 100 / 10.0, 2))
    V.localizations(spark, sf_dir).select(lines.alias("value")).write.text(path)
    return formats.read_localization(spark, path).withColumn("score", F.round("score", 2))


@query("s11_read_topology", f"WITH {V.LOCALIZATIONS} SELECT accession AS protein_id, CASE WHEN has_signal THEN 24 END AS signal_end, tm AS n_tm FROM localizations")
def s11(spark, sf_dir):
    path = scratch_path(spark, "topology")
    tm = F.transform(F.sequence(F.lit(1), F.greatest("tm", F.lit(1))), lambda i: F.concat(F.lit("FT   TRANSMEM     "), (i * 30).cast("string"), F.lit("     "), (i * 30 + 20).cast("string")))
    record = F.concat_ws("\n", F.concat(F.lit("ID   "), F.col("accession")), F.when(F.col("has_signal"), "FT   SIGNAL      1      24"), F.when(F.col("tm") > 0, F.array_join(tm, "\n")), F.lit("//"))
    V.localizations(spark, sf_dir).select(record.alias("value")).write.text(path)
    return formats.read_topology(spark, path).select("protein_id", F.col("signal.end").alias("signal_end"), F.size("tm").alias("n_tm"))


@query("s13_read_events", f"WITH {V.EVENTS} SELECT id, job_id, type, phase, step FROM ev")
def s13(spark, sf_dir):
    path = scratch_path(spark, "events-json")
    formats.write_json(V.events(spark, sf_dir), path)
    return formats.read_events(spark, path, streams.EVENT).select("id", "job_id", "type", "phase", "step")


@query("s13_read_jobs", f"WITH {_JOBS} SELECT job_id AS id, job_name AS name, status FROM jobs WHERE job_id > 10")
def s13_jobs(spark, sf_dir):
    """Job documents written to a SQL table (in the memory of the driver, so this query needs a local session) and read in ranges of ids."""
    url, driver = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    document = F.to_json(F.struct(F.col("job_name").alias("name"), "status"))
    jobs = _jobs(spark, sf_dir).select(F.col("job_id").cast("long").alias("id"), document.alias("document"))
    jobs.write.format("jdbc").options(url=url, dbtable="jobs", driver=driver, createTableColumnTypes="document VARCHAR(500)").save()
    return formats.read_jobs_jdbc(spark, url, "jobs", "name string, status string", rows_a_partition=100).filter("id > 10")


@query("s14_write_epitope_csv", f"""WITH {V.EPITOPES} SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY id)::int AS number, type, sequence, accession AS protein, accession, start::int AS position, length(sequence)::int AS "window", allele,
round(percentile, 6) AS percentile, round(antigenicity, 6) AS antigenicity, CASE WHEN toxin_safety <= 0.6 THEN 'Yes' ELSE 'No' END AS toxic, CASE WHEN allergen_safety <= 0.679 THEN 'Yes' ELSE 'No' END AS allergenic,
CASE WHEN selected THEN 'Yes' ELSE 'No' END AS selected, 17 AS columns FROM epitopes""")
def s14(spark, sf_dir):
    path = scratch_path(spark, "epitopes-csv")
    flags = {"window": F.length("sequence"), "is_toxic": F.col("toxin_safety") <= 0.6, "is_allergenic": F.col("allergen_safety") <= 0.679}
    formats.write_epitope_csv(V.epitopes(spark, sf_dir).withColumns(flags), path)
    back = spark.read.csv(path, header=True)
    number = lambda c, kind: F.col(c).cast(kind)
    return back.select(
        "run_id", number("#", "int").alias("number"), F.col("Type").alias("type"), F.col("Sequence").alias("sequence"), F.col("Source Protein").alias("protein"),
        F.col("Source Protein ID").alias("accession"), number("Position", "int").alias("position"), number("Window", "int").alias("window"), F.col("HLA Allele").alias("allele"),
        r6(number("Percentile Rank", "double")).alias("percentile"), r6(number("Antigenicity", "double")).alias("antigenicity"), F.col("Toxic").alias("toxic"),
        F.col("Allergenic").alias("allergenic"), F.col("Selected").alias("selected"), F.lit(len(back.columns) - 1).alias("columns"),
    )


@query("s15_write_fasta", f"WITH {_CONSTRUCT} SELECT count(*) AS records, sum(length(construct))::bigint AS residues FROM constructs")
def s15(spark, sf_dir):
    path = scratch_path(spark, "construct-fasta")
    rows = _constructs(spark, sf_dir)
    formats.write_fasta(rows, path, F.concat("proteome_id", F.lit("_MEV_"), F.length("sequence").cast("string"), F.lit("aa")))
    return formats.read_fasta(spark, path).agg(F.count("*").alias("records"), F.sum(F.length("sequence")).alias("residues"))


@query("s16_write_genbank", f"WITH {_CONSTRUCT} SELECT run_id, length(construct) AS n FROM constructs")
def s16(spark, sf_dir):
    path = scratch_path(spark, "genbank")
    formats.write_genbank(_constructs(spark, sf_dir).select(F.col("proteome_id").alias("run_id"), F.col("sequence").alias("construct")), path)
    records = spark.read.option("lineSep", "//\n").text(path).filter(F.trim("value") != "")
    body = F.regexp_replace(F.regexp_extract("value", r"ORIGIN\n([A-Z\n]*)", 1), r"\s", "")
    return records.select(F.regexp_extract("value", r"LOCUS\s+(\S+)", 1).alias("run_id"), F.length(body).alias("n"))


@query("s17_write_json", f"WITH {_FUNNEL} SELECT job_id, stage, n FROM fn")
def s17(spark, sf_dir):
    path = scratch_path(spark, "funnel-json")
    formats.write_json(runs.stage_funnel(V.steps(spark, sf_dir)), path)
    return spark.read.schema("job_id long, stage string, n long").json(path)


@query("s19_read_coverage_rows", "SELECT n_name AS area, n_nationkey * 4.0 AS coverage FROM nation")
def s19(spark, sf_dir):
    path = scratch_path(spark, "coverage")
    n = V.table(spark, sf_dir, "nation")
    line = F.concat("n_name", F.lit("   "), (F.col("n_nationkey") * 4.0).cast("string"), F.lit("%  1.5  2.5"))
    n.select(line.alias("value")).write.text(path)
    return formats.read_coverage_lines(spark, path).select("area", "coverage")


@query("s12_read_ca_atoms", f"WITH {V.ATOMS} SELECT structure_id, count(*) AS residues, round(sum(x), 2) AS sx FROM (SELECT structure_id::varchar AS structure_id, round(x, 3) AS x FROM atoms) GROUP BY 1")
def s12(spark, sf_dir):
    path = scratch_path(spark, "coordinates")
    three = dict(zip("ARNDCQEGHILKMFPSTWYV", "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split(), strict=True))
    name = F.element_at(F.create_map(*[F.lit(x) for p in three.items() for x in p]), F.col("aa"))
    line = F.format_string("ATOM  %5d  CA  %3s A%4d    %8.3f%8.3f%8.3f", (F.col("res_idx") % 99999).cast("int"), name, (F.col("res_idx") % 9999).cast("int"), "x", "y", "z")
    V.atoms(spark, sf_dir).select("structure_id", line.alias("value")).repartition("structure_id").write.partitionBy("structure_id").text(path)
    rows = formats.read_ca_atoms(spark, path, "structure_id=([^/]+)/")
    return rows.groupBy("structure_id").agg(F.count("*").alias("residues"), F.round(F.sum("x"), 2).alias("sx"))


__all__ = ["ORACLE_SQL", "QUERIES"]
