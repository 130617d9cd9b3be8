"""Mixing sources to target weights by Poisson replication (operator 8), DataFrame functions only.

Every document gets a count drawn from a Poisson distribution whose mean is the repetition rate of
its source, ``target share * output size / source size``. The draw inverts the distribution at a
uniform number hashed from ``doc_id`` and a seed, so it is the same on every run, on every cluster
and for every partitioning. Documents are exploded by their counts and dealt out by a hashed key,
which shuffles globally without a range sample.

A large rate is split into ``parts`` draws with a mean of at most ``MAX_MEAN`` each: the sum of
independent Poisson draws is again Poisson, so no rate is capped and no table grows past
``TABLE_LENGTH``.

Edge cases: a null source is a source of its own; a null or empty text has size 0 and counts as one
character when rates are set, so no rate divides by zero; rows that repeat a ``doc_id`` draw the same
count; a row with a null ``doc_id`` draws by its text; an empty table gives an empty result; all input columns are kept, and the added columns
``n_copies``, ``copy`` and ``shuffle_key`` replace input columns of those names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

SEED = 17
TEMPERATURE = 0.7
MAX_MEAN = 16.0
TABLE_LENGTH = 96  # beyond it the tail of Poisson(16) is below 1e-40
HASH_BITS = 48
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) hashed from the parts, the same in any engine that has md5."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("double") + 0.5) / F.lit(2.0**HASH_BITS)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, out_ratio: float = 1.0) -> DataFrame:
    """One row per source: size in characters, mean repetition ``rate`` and its split into ``parts``.

    weights: target share by source, in any unit; a source that it omits gets 0. Without weights the
    target share of a source is its size to the power ``TEMPERATURE``.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(1))).alias("size"))
    if weights is None:
        weight = F.pow(F.col("size").cast("double"), F.lit(TEMPERATURE))
    else:
        weight = F.lit(0.0)
        for source, w in weights.items():
            weight = F.when(F.col("source") == source, F.lit(float(w))).otherwise(weight)
    totals = sizes.agg(F.sum(weight).alias("all_weight"), F.sum("size").alias("all_size"))  # one row
    rate = F.try_divide(weight * F.lit(out_ratio) * F.col("all_size"), F.col("all_weight") * F.col("size"))
    rates = sizes.join(F.broadcast(totals)).select("source", "size", F.coalesce(rate, F.lit(0.0)).alias("rate"))
    return rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / MAX_MEAN), F.lit(1)).cast("int"))


def _cumulative(mean: Column) -> Column:
    """P(X <= k) of a Poisson variable for k = 0 .. TABLE_LENGTH - 1."""
    start = F.struct(F.exp(-mean).alias("p"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("table"))
    step = lambda acc, k: F.struct(
        (acc["p"] * mean / k).alias("p"),
        (acc["sum"] + acc["p"]).alias("sum"),
        F.array_append(acc["table"], acc["sum"] + acc["p"]).alias("table"),
    )
    return F.aggregate(F.sequence(F.lit(1.0).cast("int"), F.lit(TABLE_LENGTH)), start, step)["table"]


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, out_ratio: float = 1.0, seed: int = SEED) -> DataFrame:
    """``docs`` with each row repeated by its Poisson draw, in global random order."""
    rates = source_rates(docs, weights, out_ratio).select("source", "parts", _cumulative(F.col("rate") / F.col("parts")).alias("table"))
    # one row per source: broadcast where their number is checked, else Spark shuffles and splits hot sources
    rates = F.broadcast(rates) if rates.count() <= BROADCAST_SOURCES else rates
    docs = docs.drop("n_copies", "copy", "shuffle_key")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # whatever its columns are called
    name = F.coalesce(F.col("row.doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col("row.text"), F.lit("")))))
    drawn = rows.join(rates, F.col("row.source").eqNullSafe(F.col("source")))
    uniforms = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda part: uniform(F.lit(seed), part, name))
    draws = F.transform(uniforms, lambda u: F.size(F.filter("table", lambda c: c < u)))
    drawn = drawn.select("row", F.aggregate(draws, F.lit(0), lambda a, x: a + x).alias("n_copies")).filter("n_copies > 0")
    copies = drawn.select("row", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("order"), name, F.col("copy").cast("string")).cast("binary"))
    dealt = copies.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select("row.*", "n_copies", "copy", "shuffle_key")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = replicate(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "lang", "source", "text", "n_copies", "copy", "shuffle_key")


def _poisson_sql() -> str:
    terms = ", ".join(f"exp(-m) * pow(m, {k}) / {math.factorial(k)}.0" if k < 20 else f"exp({k} * ln(m) - m - lgamma({k + 1}))" for k in range(TABLE_LENGTH))
    return f"""
WITH sizes AS (SELECT source, sum(greatest(coalesce(length(text), 0), 1)) AS size FROM documents GROUP BY source),
totals AS (SELECT sum(pow(size::double, {TEMPERATURE})) AS all_weight, sum(size) AS all_size FROM sizes),
rates AS (SELECT source, pow(size::double, {TEMPERATURE}) * all_size / (all_weight * size) AS rate FROM sizes, totals),
split AS (SELECT source, greatest(ceil(rate / {MAX_MEAN}), 1)::int AS parts, rate / greatest(ceil(rate / {MAX_MEAN}), 1) AS m FROM rates),
terms AS (SELECT source, parts, unnest(range({TABLE_LENGTH})) AS k, unnest([{terms}]) AS p FROM split),
tables AS (SELECT source, parts, list(c ORDER BY k) AS table_ FROM
  (SELECT source, parts, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source, parts),
parts AS (SELECT d.doc_id, d.lang, d.source, d.text, t.table_, unnest(range(1, t.parts + 1)) AS part
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
draws AS (SELECT doc_id, lang, source, text,
  sum(len(list_filter(table_, lambda c: c < (('0x' || substr(md5('{SEED}|' || part || '|' || doc_id), 1, {HASH_BITS // 4}))::ubigint::double + 0.5) / {2.0**HASH_BITS!r})))::int AS n_copies
  FROM parts GROUP BY ALL),
copies AS (SELECT *, unnest(range(1, n_copies + 1))::int AS copy FROM draws WHERE n_copies > 0)
SELECT doc_id, lang, source, text, n_copies, copy, md5('{SEED}|order|' || doc_id || '|' || copy) AS shuffle_key FROM copies
"""


QUERIES = {"op8_source_mixing": op8_source_mixing}
ORACLE_SQL = {"op8_source_mixing": _poisson_sql()}
