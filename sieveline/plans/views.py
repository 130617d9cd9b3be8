"""Domain views over the given tables, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.helpers import word_rows

ALLELES = ("HLA-A*02:01", "HLA-B*07:02")
WORD = 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per protein: whole letter sequence of a document, standard residues only."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"),
        F.col("source").alias("proteome_id"),
        F.concat(F.lit("P"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("accession"),
        (F.col("doc_id") % 2 == 0).alias("reviewed"),
        F.regexp_replace(letters, "[BJOUXZ]", "").alias("sequence"),
    )


PROTEINS = """proteins AS (SELECT doc_id AS ord, source AS proteome_id, 'P' || lpad(doc_id::varchar, 7, '0') AS accession,
  doc_id % 2 = 0 AS reviewed,
  regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[BJOUXZ]', '', 'g') AS sequence FROM documents)"""


def line_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of a document with letters: shorter sequences, many of them copies."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    letters = F.regexp_replace(F.upper(F.regexp_replace("t", "[^A-Za-z]", "")), "[BJOUXZ]", "")
    return lines.select(F.col("source").alias("proteome_id"), (F.col("doc_id") * 1000000 + F.col("line")).alias("ord"), letters.alias("sequence")).filter("sequence <> ''")


LINE_PROTEINS = """line_proteins AS (SELECT source AS proteome_id, doc_id * 1000000 + line AS ord, sequence FROM (
  SELECT source, doc_id, i - 1 AS line, regexp_replace(upper(regexp_replace(lines[i], '[^A-Za-z]', '', 'g')), '[BJOUXZ]', '', 'g') AS sequence
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT source, doc_id, string_split(text, chr(10)) AS lines FROM documents)))
  WHERE sequence <> '')"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"),
        F.col("l_partkey").alias("subject_id"),
        F.when(flag == "A", "essential").when(flag == "N", "virulence").when(flag == "R", "human").alias("reference"),
        (F.col("l_quantity") * 2).alias("identity"),
        F.lit(100).alias("align_length"),
        F.round(F.col("l_discount") * 100).cast("int").alias("neg_log10_e"),
        (F.col("l_extendedprice") / 500).alias("bitscore"),
        F.col("l_linenumber").alias("hit_ord"),
    )


HITS = """hits AS (SELECT l_orderkey AS query_id, l_partkey AS subject_id,
  CASE l_returnflag WHEN 'A' THEN 'essential' WHEN 'N' THEN 'virulence' WHEN 'R' THEN 'human' END AS reference,
  l_quantity * 2 AS identity, 100 AS align_length, round(l_discount * 100)::int AS neg_log10_e, l_extendedprice / 500 AS bitscore,
  l_linenumber AS hit_ord FROM lineitem)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("proteome_id"))


CANDIDATES = "candidates AS (SELECT o_orderkey AS query_id, o_orderpriority AS proteome_id FROM orders)"


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proteins(spark, sf_dir).select("proteome_id", "ord", "accession", "sequence")


def words(spark: SparkSession, sf_dir: str, size: int = WORD) -> DataFrame:
    """Every ``size``-residue word of every protein with its 1-based start."""
    return word_rows(_sequences(spark, sf_dir), size)


def with_alleles(rows: DataFrame) -> DataFrame:
    """Each row for every allele."""
    return rows.withColumn("allele", F.explode(F.array(*map(F.lit, ALLELES))))


def _prefix() -> Column:
    """Four hexadecimal digits of the hash of word and allele."""
    return F.substring(F.md5(F.concat("peptide", "allele").cast("binary")), 1, 4)


def with_percentile(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("percentile", F.conv(_prefix(), 16, 10).cast("long") / 65535.0 * 100.0)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word x allele with a hashed percentile."""
    return with_percentile(with_alleles(words(spark, sf_dir)))


BINDER = 2.0


def _hashed(spark: SparkSession, sf_dir: str, **only: int) -> DataFrame:
    """Predictions whose digits are made beside the words."""
    made = word_rows(_sequences(spark, sf_dir), WORD, ALLELES, **only).withColumnRenamed("key", "allele")
    return made.withColumn("percentile", F.col("digits").cast("long") / 65535.0 * 100.0).drop("digits")


def binders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predictions of a percentile up to ``BINDER``: the digits are compared where the words are made, no other row leaves."""
    return _hashed(spark, sf_dir, most=int(BINDER * 65535 / 100)).filter(F.col("percentile") <= BINDER)


def lowest_predictions(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Predictions among which are the ``n`` lowest of every protein, ties too: a few for each batch of its words."""
    return _hashed(spark, sf_dir, best=n)


# pieces of 512 starts first: substr counts from the beginning of the string
WORDS = f"""pieces AS (SELECT proteome_id, ord, accession, c, substr(sequence, c * 512 + 1, {512 + WORD - 1}) AS piece FROM
  (SELECT *, unnest(range(0, (length(sequence) + 511) // 512)) AS c FROM proteins)),
words AS (SELECT proteome_id, ord, accession, (c * 512 + i)::int AS start, substr(piece, i, {WORD}) AS peptide FROM
  (SELECT *, unnest(range(1, length(piece) - {WORD - 2})) AS i FROM pieces WHERE length(piece) >= {WORD}))"""
PREDICTIONS = f"""{PROTEINS}, {WORDS},
predictions AS (SELECT w.*, allele, ('0x' || substr(md5(peptide || allele), 1, 4))::int::double / 65535.0 * 100.0 AS percentile
  FROM words w, (VALUES {", ".join(f"('{a}')" for a in ALLELES)}) alleles(allele))"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all kinds, an unknown one among them, with tools, messages, errors, durations and funnels where they have some."""
    kind, k, e = F.col("event_type"), F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    other = F.when(e % 7 == 0, "pipeline_paused").when(e % 7 == 1, "pipeline_resumed").when(e % 7 == 2, "pipeline_completed").when(e % 7 == 3, "note").otherwise("filter_applied")
    stages = F.array(F.struct(F.lit("input").alias("stage"), (k * 10).cast("long").alias("n")), F.struct(F.lit("kept").alias("stage"), k.cast("long").alias("n")))
    rows = table(spark, sf_dir, "events").select(
        e.alias("id"),
        F.col("user_id").alias("job_id"),
        F.when(kind == "signup", "step_started").when(kind == "view", "step_progress").when(kind == "click", "step_completed").when(kind == "error", "step_failed").otherwise(other).alias("type"),
        (k % 14 + 1).alias("phase"),
        (k % 5 + 1).alias("step"),
        F.when(e % 6 != 0, F.col("value")).alias("percent"),
        "ts",
        F.when(e % 3 == 0, F.concat(F.lit("tool-"), k.cast("string"))).alias("tool"),
        F.when(e % 2 == 0, F.concat(F.lit("message "), k.cast("string"))).alias("message"),
        F.when(e % 5 != 0, F.concat(F.lit("error "), k.cast("string"))).alias("error"),
        F.when(e % 4 != 0, k % 4).alias("duration"),
        F.when(e % 4 != 0, stages).otherwise(F.slice(stages, 1, 0)).alias("funnel"),
    )
    return rows.withColumn("funnel", F.when(F.col("type") == "filter_applied", F.col("funnel")))


EVENTS = """ev AS (SELECT *, CASE WHEN type = 'filter_applied' AND id % 4 <> 0 THEN 'input:' || k * 10 || ',kept:' || k END AS funnel FROM (
  SELECT event_id AS id, user_id AS job_id, json_extract_string(props, '$.k')::int AS k,
  CASE event_type WHEN 'signup' THEN 'step_started' WHEN 'view' THEN 'step_progress' WHEN 'click' THEN 'step_completed' WHEN 'error' THEN 'step_failed'
    ELSE CASE event_id % 7 WHEN 0 THEN 'pipeline_paused' WHEN 1 THEN 'pipeline_resumed' WHEN 2 THEN 'pipeline_completed' WHEN 3 THEN 'note' ELSE 'filter_applied' END END AS type,
  (json_extract_string(props, '$.k')::int % 14 + 1) AS phase, (json_extract_string(props, '$.k')::int % 5 + 1) AS step,
  CASE WHEN event_id % 6 <> 0 THEN value END AS percent, ts,
  CASE WHEN event_id % 3 = 0 THEN 'tool-' || json_extract_string(props, '$.k') END AS tool, CASE WHEN event_id % 2 = 0 THEN 'message ' || json_extract_string(props, '$.k') END AS message,
  CASE WHEN event_id % 5 <> 0 THEN 'error ' || json_extract_string(props, '$.k') END AS error, CASE WHEN event_id % 4 <> 0 THEN json_extract_string(props, '$.k')::int % 4 END AS duration FROM events))"""


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue positions: structure, index, one-letter residue and coordinates."""
    xyz = [(F.element_at("embedding", i).cast("double") * 60).alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))]
    residue = F.substr(F.lit("ARNDCQEGHILKMFPSTWYV"), (F.col("vec_id") % 20 + 1).cast("int"), F.lit(1))
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("structure_id"), F.col("vec_id").alias("res_idx"), residue.alias("aa"), *xyz)


ATOMS = """atoms AS (SELECT label AS structure_id, vec_id AS res_idx, substr('ARNDCQEGHILKMFPSTWYV', (vec_id % 20 + 1)::int, 1) AS aa,
  embedding[1]::double * 60 AS x, embedding[2]::double * 60 AS y, embedding[3]::double * 60 AS z FROM embeddings)"""

LABELS = ("CytoplasmicMembrane", "Cell Wall", "Extracellular", "Cytoplasmic", "Unknown", "Lipoprotein")


def localizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per protein: localization label, signal peptide flag, membrane regions, whether topology has evidence."""
    ord_ = F.col("ord")
    label = F.element_at(F.array(*map(F.lit, LABELS)), (ord_ % 6 + 1).cast("int"))
    return proteins(spark, sf_dir).select(
        "proteome_id", "ord", "accession", label.alias("label"), (ord_ % 4 == 1).alias("has_signal"), (ord_ % 4 - 1).cast("int").alias("tm"),
        (ord_ % 7 != 0).alias("has_evidence"),
    ).withColumn("tm", F.greatest("tm", F.lit(0)))


LOCALIZATIONS = f"""{PROTEINS}, localizations AS (SELECT proteome_id, ord, accession,
  [{", ".join(f"'{x}'" for x in LABELS)}][(ord % 6 + 1)::int] AS label, ord % 4 = 1 AS has_signal, greatest((ord % 4 - 1)::int, 0) AS tm,
  ord % 7 <> 0 AS has_evidence FROM proteins)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run steps from orders: run, phase, step, status, seconds."""
    o = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_custkey").alias("job_id"), (F.col("o_orderkey") % 14 + 1).cast("int").alias("phase"), (F.col("o_orderkey") % 50 + 1).cast("int").alias("step"),
        F.when(status == "F", "success").when(status == "O", "running").otherwise("failed").alias("status"),
        F.col("o_totalprice").alias("seconds"), F.col("o_orderpriority").alias("stage"),
    )


STEPS = """steps AS (SELECT o_custkey AS job_id, (o_orderkey % 14 + 1)::int AS phase, (o_orderkey % 50 + 1)::int AS step,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, o_totalprice AS seconds,
  o_orderpriority AS stage FROM orders)"""


def epitopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong binders as epitopes: run, id, type, peptide, allele, rank, scores, selected flag."""
    p = binders(spark, sf_dir)
    kind = F.when(F.col("start") % 3 == 0, "CTL").when(F.col("start") % 3 == 1, "HTL").otherwise("BCELL_LINEAR")
    id_ = F.concat_ws("-", "accession", F.col("start").cast("string"), F.translate("allele", "*:", ""))
    digest = lambda at: F.conv(F.substring(F.md5(F.col("id").cast("binary")), at, 4), 16, 10).cast("double") / 65535.0
    return p.withColumn("id", id_).select(
        F.col("proteome_id").alias("run_id"), "id", kind.alias("type"), F.col("peptide").alias("sequence"), "ord", "accession", "start", "allele",
        F.when(F.col("ord") % 11 != 0, F.col("percentile")).alias("percentile"), digest(5).alias("antigenicity"),
        F.when(F.col("ord") % 13 != 0, digest(9)).alias("allergen_safety"), F.when(F.col("ord") % 17 != 0, digest(13)).alias("toxin_safety"),
        F.when(F.col("ord") % 19 != 0, F.col("ord") % 5 != 0).alias("selected"),
    )


_D = "('0x' || substr(md5(id), {}, 4))::int::double / 65535.0"
EPITOPES = f"""{PREDICTIONS}, epitopes AS (SELECT proteome_id AS run_id, id,
  CASE start % 3 WHEN 0 THEN 'CTL' WHEN 1 THEN 'HTL' ELSE 'BCELL_LINEAR' END AS type, peptide AS sequence, ord, accession, start, allele,
  CASE WHEN ord % 11 <> 0 THEN percentile END AS percentile, {_D.format(5)} AS antigenicity,
  CASE WHEN ord % 13 <> 0 THEN {_D.format(9)} END AS allergen_safety, CASE WHEN ord % 17 <> 0 THEN {_D.format(13)} END AS toxin_safety,
  CASE WHEN ord % 19 <> 0 THEN ord % 5 <> 0 END AS selected
  FROM (SELECT *, accession || '-' || start || '-' || translate(allele, '*:', '') AS id FROM predictions WHERE percentile <= 2.0))"""
