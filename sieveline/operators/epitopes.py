"""Epitope operators: selection, ranking, safety filters, coverage, overlap and construct assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import scales as S
from sieveline.functions import scoring
from sieveline.functions.helpers import words_of
from sieveline.sources.scratch import written

NO_RANK = 999.0
BROADCAST_ALLELES = 100_000


def strong_binders(predictions: DataFrame, cutoff: float = 2.0) -> DataFrame:
    """A missing percentile fails."""
    return predictions.filter(F.col("percentile") <= cutoff)


def top_per_protein(predictions: DataFrame, n: int = 5) -> DataFrame:
    """The n lowest percentiles of each protein; a missing one counts as 999."""
    rank = F.row_number().over(Window.partitionBy("proteome_id", "ord").orderBy(F.coalesce("percentile", F.lit(NO_RANK)), "start", "allele"))
    return predictions.withColumn("rank", rank).filter(F.col("rank") <= n)


def allele_frequencies(frame: DataFrame) -> DataFrame:
    """The allele dimension: a fixed table of a few dozen rows."""
    return frame.sparkSession.createDataFrame(list(S.ALLELE_FREQUENCY.items()), "allele string, frequency double")


def with_frequency(rows: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """Adds the allele's frequency, 0 where it is unknown."""
    small = frequencies is None or frequencies.limit(BROADCAST_ALLELES + 1).count() <= BROADCAST_ALLELES
    known = allele_frequencies(rows) if frequencies is None else frequencies
    return rows.join(F.broadcast(known) if small else known, "allele", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0.0)))  # a fixed dimension


def frequency_bonus(frequency: Column) -> Column:
    bonus = 3.0 * (1.0 + F.log10(F.greatest(frequency, F.lit(1e-300)) / 0.01))
    return F.when(frequency > 0, scoring.clamp(bonus, 0.0, 5.0)).otherwise(F.lit(0.0))


def cap_by_rank(rows: DataFrame, cap: int = 30) -> DataFrame:
    """The ``cap`` best of each proteome by percentile less the allele bonus."""
    key = F.coalesce("percentile", F.lit(NO_RANK)) - frequency_bonus(F.col("frequency"))
    ranked = with_frequency(rows).withColumn("key", F.round(key, 9))
    rank = F.row_number().over(Window.partitionBy("proteome_id").orderBy("key", "ord", "start", "allele"))
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= cap)


def serialize_epitopes(predictions: DataFrame, proteins: DataFrame, kind: str = "CTL") -> DataFrame:
    """Predictions as epitope rows: accession attached by position (``unknown`` without one) and a readable id."""
    source = proteins.select("ord", F.col("accession").alias("source_accession"))
    joined = predictions.drop("accession").join(source, "ord", "left").withColumn("source_accession", F.coalesce("source_accession", F.lit("unknown")))
    tag = F.translate("allele", "*:", "")
    id_ = F.concat_ws("-", F.lit(kind), "source_accession", F.col("start").cast("string"), F.length("peptide").cast("string"), tag)
    return joined.select(id_.alias("id"), F.lit(kind).alias("type"), F.col("peptide").alias("sequence"), "source_accession", "start", "allele", "percentile")


def is_safe() -> Column:
    """Safety scores above their limits; a missing score passes."""
    allergen, toxin = F.col("allergen_safety"), F.col("toxin_safety")
    return (allergen.isNull() | (allergen > 0.679)) & (toxin.isNull() | (toxin > 0.60))


def fits_length() -> Column:
    n = F.length("sequence")
    return (
        F.when(F.col("type") == "CTL", n.between(8, 12)).when(F.col("type") == "HTL", n.between(13, 20)).when(F.startswith("type", F.lit("BCELL")), n <= 25)
        .otherwise(F.lit(False))
    )


def by_type(epitopes: DataFrame, kind: str | None) -> DataFrame:
    """Equality on the type; ``BCELL`` covers both B-cell types; no kind keeps all."""
    if kind is None:
        return epitopes
    return epitopes.filter(F.startswith("type", F.lit("BCELL")) if kind == "BCELL" else F.col("type") == kind)


def selected_nonempty() -> Column:
    return F.coalesce("selected", F.lit(True)) & (F.trim(F.coalesce("sequence", F.lit(""))) != "")


def append_epitopes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Union by id; an existing id wins."""
    return existing.unionByName(new.join(existing.select("id"), "id", "left_anti"), allowMissingColumns=True)


def conserved_epitopes(epitopes: DataFrame, conservancy: DataFrame, at_least: float = 70.0) -> DataFrame:
    rows = conservancy.filter(F.col("value") >= at_least).select(F.col("peptide").alias("sequence")).distinct()
    return epitopes.join(rows, "sequence", "left_semi")


def _typed_peptides(epitopes: DataFrame) -> DataFrame:
    """Distinct peptides (upper-case letters) of the selected epitopes of a run, with the numbers of B-cell and T-cell epitopes that have them.

    Written once: all joins below read this table and none makes the epitopes again.
    """
    is_b = F.startswith("type", F.lit("BCELL"))
    peptide = F.upper(F.regexp_replace("sequence", "[^A-Za-z]", ""))
    counted = epitopes.filter(selected_nonempty()).groupBy("run_id", peptide.alias("peptide")).agg(F.count_if(is_b).alias("n_b"), F.count_if(~is_b).alias("n_t"))
    return written(counted, "typed-peptides")


def bt_overlap(epitopes: DataFrame) -> DataFrame:
    """Pairs of a B-cell and a T-cell peptide of a run where one contains the other; the overlap is the shorter one.

    One row for each pair of distinct peptides, with the numbers of epitopes that have them: members
    follow from the selected epitopes by peptide and aren't multiplied here. The longer side is exploded
    to its substrings of the lengths that occur on the other side, so the pairs come from an equi-join.
    """
    return _overlaps(_typed_peptides(epitopes))


def _overlaps(counted: DataFrame) -> DataFrame:
    bp = counted.filter("n_b > 0").select("run_id", F.col("peptide").alias("b_peptide"), "n_b")
    tp = counted.filter("n_t > 0").select("run_id", F.col("peptide").alias("t_peptide"), "n_t")
    found = _contained(tp, "t_peptide", bp, "b_peptide", True).unionByName(_contained(bp, "b_peptide", tp, "t_peptide", False))
    overlap = F.when(F.length("b_peptide") <= F.length("t_peptide"), F.col("b_peptide")).otherwise(F.col("t_peptide"))
    return found.select("run_id", "b_peptide", "t_peptide", overlap.alias("overlap"), "n_b", "n_t")


def _contained(short: DataFrame, s: str, long: DataFrame, name: str, equal: bool) -> DataFrame:
    """Rows of both where s lies in name; equal ones only on demand, so that both directions have no pair in common."""
    lengths = short.select("run_id", F.length(s).alias("k")).distinct()
    k, n = F.col("k"), F.length(name)
    cut = long.join(lengths, "run_id").filter((k > 0) & ((k <= n) if equal else (k < n)))
    parts = F.when(k == n, F.array(name)).otherwise(F.array_distinct(words_of(F.col(name), k)))
    return cut.select(*long.columns, F.explode(parts).alias(s)).join(short, ["run_id", s])


def overlap_summary(epitopes: DataFrame) -> DataFrame:
    """Per run: B and T counts, B epitopes with a match, pairs."""
    counted = _typed_peptides(epitopes)
    counts = counted.groupBy("run_id").agg(F.sum("n_b").alias("n_b"), F.sum("n_t").alias("n_t"))
    found = _overlaps(counted).groupBy("run_id", "b_peptide").agg(F.first("n_b").alias("n_b"), F.sum("n_t").alias("n_t"))
    found = found.groupBy("run_id").agg(F.sum("n_b").alias("b_matched"), F.sum(F.col("n_b") * F.col("n_t")).alias("pairs"))
    return counts.join(found, "run_id", "left").fillna(0, ["b_matched", "pairs"])


def population_coverage(epitopes: DataFrame) -> DataFrame:
    """Percent of people with at least one of a run's alleles: 100 (1 - prod(1 - carriers)), one decimal."""
    alleles = epitopes.select("run_id", F.upper("allele").alias("allele")).distinct()
    carriers = 1 - F.pow(1 - F.col("frequency"), 2)
    out = with_frequency(alleles).groupBy("run_id").agg(F.product(1 - carriers).alias("uncovered"), F.count_if(F.col("frequency") > 0).alias("matched"))
    return out.select("run_id", "matched", F.round(F.least(100 * (1 - F.col("uncovered")), F.lit(100.0)), 1).alias("coverage"))


def select_for_construct(epitopes: DataFrame) -> DataFrame:
    """Safe epitopes by type: the best by rank (CTL, HTL) or antigenicity (B cell) up to the caps, in assembly order."""
    kind = F.when(F.startswith("type", F.lit("BCELL")), "BCELL").otherwise(F.col("type"))
    pool = epitopes.filter(selected_nonempty() & is_safe()).withColumn("kind", kind)
    lead = F.when(F.col("kind") == "BCELL", -F.coalesce("antigenicity", F.lit(0.0))).otherwise(F.coalesce("percentile", F.lit(NO_RANK)))
    by = Window.partitionBy("run_id", "kind").orderBy(lead, F.col("antigenicity").desc_nulls_last(), "id")
    cap = F.when(F.col("kind") == "CTL", S.CONSTRUCT_CAPS["CTL"]).when(F.col("kind") == "HTL", S.CONSTRUCT_CAPS["HTL"]).otherwise(S.CONSTRUCT_CAPS["BCELL"])
    best = pool.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= cap)
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("kind_ord", "accession", "allele", "start", "rank"))
    order = F.when(F.col("kind") == "CTL", 1).when(F.col("kind") == "HTL", 2).otherwise(3)
    return best.withColumn("kind_ord", order).withColumn("seg_ord", place)


def assemble_construct(chosen: DataFrame, adjuvant: str = "", signal: str = "") -> DataFrame:
    """One sequence per run: signal, adjuvant and its linker, then joined CTL, HTL and B-cell epitopes.

    At most the caps' sum of epitopes is gathered for a run. An empty group drops out with its linkers.
    """
    of = lambda kind: F.transform(
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("seg_ord", "sequence")))), lambda s: s["sequence"]
    )
    groups = chosen.groupBy("run_id").agg(of("CTL").alias("c"), of("HTL").alias("h"), of("BCELL").alias("b"))
    part = lambda name, linker: F.when(F.size(name) > 0, F.array_join(name, linker))
    body = F.concat_ws(
        "", F.lit(signal), F.lit(adjuvant), F.lit(S.LINKERS["adjuvant"]), part("c", S.LINKERS["ctl"]),
        F.when(F.size("h") > 0, F.concat(F.lit(S.LINKERS["htl"]), part("h", S.LINKERS["htl"]))),
        F.when(F.size("b") > 0, F.concat(F.lit(S.LINKERS["bcell"]), part("b", S.LINKERS["bcell"]))),
    )
    return groups.select("run_id", body.alias("construct"), F.size("c").alias("n_ctl"), F.size("h").alias("n_htl"), F.size("b").alias("n_bcell"))


def segment_offsets(chosen: DataFrame) -> DataFrame:
    """Start and end of each chosen epitope when they are laid end to end."""
    w = Window.partitionBy("run_id").orderBy("seg_ord").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("sequence")).over(w)
    return chosen.select("run_id", "seg_ord", "id", (end - F.length("sequence") + 1).alias("seg_start"), end.alias("seg_end"))


def score_epitopes(epitopes: DataFrame) -> DataFrame:
    """All peptide scores in one pass over the distinct peptides, joined back.

    Where the epitopes have an ``ic50`` the cytokine scores take their binding from it, else it counts 0.
    The epitopes are read twice: a caller that makes them by much work writes them first.
    """
    seq = F.col("sequence")
    key = [c for c in ("sequence", "ic50") if c in epitopes.columns]
    peptides = epitopes.select(*key).distinct()
    binding = F.coalesce(scoring.binding_from_ic50(F.col("ic50")), F.lit(0.0)) if "ic50" in key else F.lit(0.0)
    ifn, is_ifn = scoring.ifn_gamma(seq, binding)
    i4, is_i4 = scoring.il4(seq, binding)
    i10, is_i10 = scoring.il10(seq, binding)
    scored = peptides.select(
        *key, scoring.short_antigenicity(seq).alias("antigen_score"), (1 - scoring.allergenicity(seq)).alias("allergen_score"),
        (1 - scoring.toxicity(seq)).alias("toxin_score"), scoring.tap_transport(seq).alias("tap"), ifn.alias("ifn"), is_ifn.alias("is_ifn"),
        i4.alias("il4"), is_i4.alias("is_il4"), i10.alias("il10"), is_i10.alias("is_il10"),
    )
    if key == ["sequence"]:
        return epitopes.join(scored, "sequence")
    same = (epitopes["sequence"] == scored["sequence"]) & epitopes["ic50"].eqNullSafe(scored["ic50"])
    return epitopes.join(scored, same).select(epitopes["*"], *[scored[c] for c in scored.columns if c not in key])


def score_immunogenicity(rows: DataFrame) -> DataFrame:
    """``rows`` with class_one, class_two, ``score`` and ``error``: why a row can't be scored, else null.

    rows: sequence, allele, rank (percentile), ic50 and ic50_two (nM, null where not measured). Class I comes from ic50, else from the
    rank; class II from ic50_two, else it is 0. A ``tap`` column is taken as the transport score.
    """
    error = scoring.immunogenicity_error(F.col("allele"), F.col("rank"), F.col("ic50"))
    one = F.when(F.col("ic50").isNotNull(), scoring.binding_from_ic50(F.col("ic50"))).otherwise(scoring.rank_binding(F.col("rank")))
    two = F.coalesce(scoring.binding_from_ic50(F.col("ic50_two")), F.lit(0.0))
    made = rows.withColumns({"error": error, "class_one": one, "class_two": two})
    tap = F.col("tap") if "tap" in rows.columns else scoring.tap_transport(F.col("sequence"))
    score = scoring.immunogenicity(F.col("sequence"), F.col("class_one"), F.col("class_two"), tap)
    return made.withColumn("score", F.when(F.col("error").isNull(), score))
