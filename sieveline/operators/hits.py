"""Alignment-hit operators: best hits, filters and summaries by query.

Best hits are aggregates (``min_by`` over a struct), which combine on the map side, so a query with
very many hits is no bottleneck. Null keys never match; no-hit queries are kept where stated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIT = ("subject_id", "identity", "align_length", "neg_log10_e", "bitscore")
TIES = ("hit_ord", "subject_id", "identity", "bitscore", "neg_log10_e")


def policy_order(policy: str) -> list[Column]:
    """``first``: file order; ``min_evalue``: least e-value; ``max_identity``: greatest identity."""
    lead = {"first": [], "min_evalue": [-F.col("neg_log10_e")], "max_identity": [-F.col("identity")]}[policy]
    return [*lead, *map(F.col, TIES)]


def best_hit(hits: DataFrame, policy: str, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """One hit for each key, by the policy and then file order."""
    best = F.min_by(F.struct(*HIT), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(policy_order(policy))]))
    return hits.groupBy(*keys).agg(best.alias("h")).select(*keys, "h.*")


def attach_best_hit(candidates: DataFrame, hits: DataFrame, policy: str = "min_evalue") -> DataFrame:
    """Candidates with their best hit; those without a hit have nulls."""
    return candidates.join(best_hit(hits, policy), "query_id", "left")


def essential_filter(candidates: DataFrame, hits: DataFrame, least_identity: float = 40.0, least_e: int = 5) -> DataFrame:
    """Candidates whose first hit has enough identity over its length and a small enough e-value."""
    found = attach_best_hit(candidates, hits, "first")
    return found.filter((F.try_divide(F.col("identity"), F.col("align_length")) * 100 >= least_identity) & (F.col("neg_log10_e") >= least_e))


def virulence_flag(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """All candidates with ``is_virulent``: best hit of 30 % identity, e-value 1e-4, bit score over 100."""
    found = attach_best_hit(candidates, hits, "min_evalue")
    good = (F.col("identity") >= 30) & (F.col("neg_log10_e") >= 4) & (F.col("bitscore") > 100)
    return found.withColumn("is_virulent", F.coalesce(good, F.lit(False)))


def homology_summary(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """Per candidate: greatest identity, least e-value and hit count; 0, 1.0 and 0 without a hit."""
    by_query = hits.groupBy("query_id").agg(F.max("identity").alias("max_identity"), F.max("neg_log10_e").alias("e"), F.count("*").alias("n_hits"))
    joined = candidates.join(by_query, "query_id", "left")
    return joined.withColumns(
        {
            "max_identity": F.coalesce("max_identity", F.lit(0.0)),
            "min_evalue": F.coalesce(F.pow(F.lit(10.0), -F.col("e")), F.lit(1.0)),
            "n_hits": F.coalesce("n_hits", F.lit(0)),
        }
    ).drop("e")


def exclude_homologs(candidates: DataFrame, hits: DataFrame, at_least: float = 30.0) -> DataFrame:
    """Candidates without any hit of that identity."""
    homologs = hits.filter(F.col("identity") >= at_least).select("query_id").distinct()
    return candidates.join(homologs, "query_id", "left_anti")


def hit_stats(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries, queries with hits, best e-value exponent and its identity, by reference."""
    best = F.max_by("identity", F.struct("neg_log10_e", F.col("identity")))
    by_reference = hits.groupBy("reference").agg(F.count_distinct("query_id").alias("with_hits"), F.max("neg_log10_e").alias("best_e"), best.alias("best_identity"))
    return by_reference.join(F.broadcast(candidates.agg(F.count("*").alias("n_queries"))))  # one row


def hit_funnel(candidates: DataFrame, hits: DataFrame) -> DataFrame:
    """Counts by proteome of candidates, essential, virulent and non-homologous ones, all filters in one pass over the hits."""
    order = lambda policy: F.struct(*[c.alias(f"o{i}") for i, c in enumerate(policy_order(policy))])
    of = lambda ref, policy: F.min_by(F.struct(*HIT), F.when(F.col("reference") == ref, order(policy)))
    flags = hits.groupBy("query_id").agg(
        of("essential", "first").alias("e"),
        of("virulence", "min_evalue").alias("v"),
        F.max(F.when(F.col("reference") == "human", F.col("identity"))).alias("human"),
    )
    essential = (F.col("e.identity") / F.col("e.align_length") * 100 >= 40) & (F.col("e.neg_log10_e") >= 5)
    virulent = (F.col("v.identity") >= 30) & (F.col("v.neg_log10_e") >= 4) & (F.col("v.bitscore") > 100)
    stage = candidates.join(flags, "query_id", "left").select(
        "proteome_id",
        F.coalesce(essential, F.lit(False)).alias("essential"),
        F.coalesce(virulent, F.lit(False)).alias("virulent"),
        (F.coalesce("human", F.lit(0.0)) < 30).alias("non_human"),
    )
    return stage.groupBy("proteome_id").agg(
        F.count("*").alias("candidates"),
        F.count_if("essential").alias("essential"),
        F.count_if(F.col("essential") & F.col("virulent")).alias("virulent"),
        F.count_if(F.col("essential") & F.col("virulent") & F.col("non_human")).alias("targets"),
    )
