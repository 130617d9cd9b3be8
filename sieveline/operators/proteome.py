"""Proteome operators: deduplication, counts, validity, localization and topology rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import scales as S


def dedup_accession(records: DataFrame) -> DataFrame:
    """One row per proteome and accession: a reviewed one wins, else the first; ``?`` rows are never merged.

    The row keeps the smallest ``ord`` of its group, which is the first-seen order.
    """
    key = F.when(F.col("accession") == "?", F.concat(F.lit("?:"), F.col("ord").cast("string"))).otherwise(F.col("accession"))
    keyed = records.withColumn("__key", key)
    best = F.max_by(F.struct(*records.columns), F.struct(F.coalesce("reviewed", F.lit(False)), -F.col("ord")))
    grouped = keyed.groupBy("proteome_id", "__key").agg(best.alias("r"), F.min("ord").alias("first_ord"))
    return grouped.select("r.*", "first_ord")


def count_check(records: DataFrame, metadata: DataFrame) -> DataFrame:
    """Loaded against expected counts by proteome; ``ok`` is false on any difference."""
    loaded = records.groupBy("proteome_id").agg(F.count("*").alias("loaded"), F.count_distinct("accession").alias("distinct_accessions"))
    joined = metadata.join(loaded, "proteome_id", "full_outer").withColumn("loaded", F.coalesce("loaded", F.lit(0)))
    return joined.withColumn("ok", F.coalesce(F.col("loaded") == F.col("expected"), F.lit(False)))


def proteome_stats(records: DataFrame) -> DataFrame:
    n = F.length("sequence")
    return records.groupBy("proteome_id").agg(
        F.count("*").alias("proteins"), F.sum(n).alias("residues"), F.min(n).alias("shortest"), F.max(n).alias("longest")
    )


def valid_sequence(seq: Column) -> Column:
    """Only the 20 standard letters once white space is gone and letters are upper case.

    Letters are put in upper case one by one (a dotless i and a long s have I and S); ``upper`` would make two of a sharp s or a ligature,
    and ``$`` would also match before a line separator at the end.
    """
    return F.regexp_replace(seq, r"\s", "").rlike(r"^[ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy\u0131\u017F]+\z")


def exact_duplicates(records: DataFrame) -> DataFrame:
    """One row per distinct sequence: hash, smallest ``ord`` and number of copies."""
    return records.groupBy(F.sha2("sequence", 256).alias("sha")).agg(F.min("ord").alias("ord"), F.count("*").alias("copies"))


def incremental_score(records: DataFrame, store: DataFrame, score: Column) -> tuple[DataFrame, DataFrame]:
    """(new rows for the store, all records with their score): only sequences whose hash the store lacks are scored."""
    hashed = records.withColumn("sha", F.sha2("sequence", 256))
    fresh = hashed.select("sha", "sequence").dropDuplicates(["sha"]).join(store, "sha", "left_anti")
    new = fresh.select("sha", score.alias("score"))
    return new, hashed.join(store.unionByName(new), "sha", "left")


def localization_category(label: Column) -> Column:
    token = F.regexp_replace(F.lower(label), "[^a-z0-9]", "")
    out = F.lit("unknown")
    for name, category in S.LOCALIZATION_CATEGORY.items():
        out = F.when(token == name, category).otherwise(out)
    return out


def is_surface(label: Column) -> Column:
    return localization_category(label).isin(*S.SURFACE_CATEGORIES)


def topology_class(tm: Column, has_signal: Column) -> Column:
    return F.when(tm > 0, "membrane").when(has_signal, "secreted").otherwise("intracellular")


def topology_surface(tm: Column, has_signal: Column) -> Column:
    """Secreted or membrane with at most one membrane region; unknown topology is never kept."""
    return F.coalesce(topology_class(tm, has_signal).isin("secreted", "membrane") & (tm <= 1), F.lit(False))


def surface_rule(label: Column, tm: Column, has_signal: Column, has_evidence: Column) -> Column:
    """Topology surface, or localization surface unless the topology says intracellular with evidence."""
    buried = (topology_class(tm, has_signal) == "intracellular") & F.coalesce(has_evidence, F.lit(False))
    return topology_surface(tm, has_signal) | (F.coalesce(is_surface(label), F.lit(False)) & ~buried)


def surface_union(located: DataFrame) -> DataFrame:
    """Rows that the surface rule keeps, one per accession (``?`` rows by ``ord``), in input order."""
    kept = located.filter(surface_rule(F.col("label"), F.col("tm"), F.col("has_signal"), F.col("has_evidence")))
    key = F.when(F.col("accession") == "?", F.concat(F.lit("?:"), F.col("ord").cast("string"))).otherwise(F.col("accession"))
    rank = F.row_number().over(Window.partitionBy("proteome_id", key).orderBy("ord"))
    return kept.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def localization_counts(located: DataFrame) -> DataFrame:
    return located.groupBy("label").agg(F.count("*").alias("n"), F.count_if(is_surface(F.col("label"))).alias("n_surface"))


def topology_counts(located: DataFrame) -> DataFrame:
    kind = topology_class(F.col("tm"), F.col("has_signal"))
    return located.groupBy("proteome_id").agg(*[F.count_if(kind == k).alias(k) for k in ("secreted", "membrane", "intracellular")])


def pick_reference_proteome(metadata: DataFrame) -> DataFrame:
    """The reference proteome of each taxon; a taxon without exactly one raises when its row is read."""
    found = metadata.filter(F.col("proteome_type") == "Reference proteome").groupBy("taxon_id")
    picked = found.agg(F.count("*").alias("n"), F.first("proteome_id").alias("proteome_id"), F.first("protein_count").alias("protein_count"))
    exact = F.when(F.col("n") == 1, F.col("proteome_id")).otherwise(F.raise_error(F.lit("a taxon needs exactly one reference proteome")))
    return picked.select("taxon_id", exact.alias("proteome_id"), "protein_count")


def essential_scope(genes: DataFrame, scope: str | None, aliases: dict[str, str | None]) -> DataFrame:
    """Reference genes of a scope: an alias resolves to an organism substring, or to no filter at all."""
    organism = aliases.get((scope or "").strip().lower(), scope)
    return genes if organism is None else genes.filter(F.contains("organism", F.lit(organism)))
