"""Sequence scores as column expressions: they take and return Columns and stay inside code generation.

These are documented approximations of screening rules, no substitute for laboratory assays or the
official prediction tools. A null sequence gives a null score.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scales as S


def n_of(seq: Column, letters: str) -> Column:
    """How often any of the letters occurs."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def weighted(seq: Column, weights: dict[str, float], other: float = 0.0) -> Column:
    """Sum of the residues' weights; residues without one count ``other``."""
    total = reduce(add, [n_of(seq, aa) * F.lit(float(w)) for aa, w in weights.items()])
    return total if not other else total + (F.length(seq) - n_of(seq, "".join(weights))) * F.lit(other)


def share(seq: Column, letters: str) -> Column:
    return F.try_divide(n_of(seq, letters), F.length(seq))


def lookup(letter: Column, values: dict[str, float], default: float) -> Column:
    """Value of an upper-case letter, from an array by its code."""
    table = F.array(*[F.lit(float(values.get(chr(c), default))) for c in range(ord("A"), ord("Z") + 1)])
    return F.coalesce(F.get(table, F.ascii(letter) - ord("A")), F.lit(float(default)))


def motif_sum(seq: Column, motifs) -> Column:
    return reduce(add, [F.when(seq.rlike(rx), F.lit(float(v))).otherwise(F.lit(0.0)) for rx, v in motifs])


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def molecular_weight_kda(seq: Column) -> Column:
    return weighted(seq, S.WEIGHTS, S.OTHER_WEIGHT) / 1000.0


def allergenicity(seq: Column, reference_match: Column | None = None, domains: Column | None = None) -> Column:
    """Allergen score: reference match over 35 %, allergen domain, first motif, weight of 5 to 80 kDa."""
    score = F.when(reduce(lambda a, b: a | b, [seq.rlike(rx) for rx in S.ALLERGEN_MOTIFS]), F.lit(0.3)).otherwise(F.lit(0.0))
    score = score + F.when(molecular_weight_kda(seq).between(5.0, 80.0), F.lit(0.1)).otherwise(F.lit(0.0))
    if reference_match is not None:
        score = score + F.when(reference_match > 35.0, reference_match / 100.0 * 0.6).otherwise(F.lit(0.0))
    if domains is not None:
        score = score + F.when(F.arrays_overlap(domains, F.array(*map(F.lit, S.ALLERGEN_DOMAINS))), F.lit(0.4)).otherwise(F.lit(0.0))
    return F.least(score, F.lit(1.0))


def toxicity(seq: Column) -> Column:
    return motif_sum(seq, S.TOXIN_MOTIFS)


def short_antigenicity(seq: Column) -> Column:
    """Composition score of a peptide of fewer than 37 residues."""
    score = (
        0.35 * F.least(share(seq, "DEKR") * 3, F.lit(1.0))
        + 0.25 * F.least(share(seq, "FWY") * 5, F.lit(1.0))
        + 0.25 * F.greatest(1.0 - F.abs(share(seq, "AILMFWV") - 0.45) * 2, F.lit(0.0))
        + 0.15 * F.least(share(seq, "STNQC") * 3, F.lit(1.0))
    )
    return F.when(F.length(seq) > 0, clamp(score, 0.1, 0.95)).otherwise(F.lit(0.3))


def ifn_gamma(seq: Column, binding: Column) -> tuple[Column, Column]:
    """(score, is inducer): a strong binder needs any motif, others the combined score."""
    motifs = motif_sum(seq, S.IFN_MOTIFS)
    length = F.when(F.length(seq) >= 8, F.least(F.length(seq) / 15.0, F.lit(1.0))).otherwise(F.lit(0.0))
    score = motifs * 0.4 + binding * 0.4 + length * 0.2
    return score, (score >= 0.45) | ((binding >= 0.7) & (motifs > 0))


def il4(seq: Column, binding: Column) -> tuple[Column, Column]:
    motifs = motif_sum(seq, S.IL4_MOTIFS)
    return F.least(motifs / 2.0, F.lit(1.0)), (motifs / 2.0 >= 0.2) | ((binding >= 0.7) & (motifs > 0))


def il10(seq: Column, binding: Column, threshold: float = -0.3) -> tuple[Column, Column]:
    motifs = motif_sum(seq, S.IL10_MOTIFS)
    return F.least(motifs / 1.5, F.lit(1.0)), (motifs / 1.5 >= threshold) | ((binding >= 0.7) & (motifs > 0))


def binding_from_ic50(ic50: Column) -> Column:
    """1 / (1 + log10(ic50 / 100)), floored at 0.01 inside the logarithm; null at the pole."""
    return F.when(ic50 <= 0, F.lit(1.0)).otherwise(F.try_divide(F.lit(1.0), 1.0 + F.log10(F.greatest(ic50 / 100.0, F.lit(0.01)))))


def tap_transport(seq: Column, n_hydrophobic: Column | None = None) -> Column:
    """``n_hydrophobic``: the number of letters among AILMFWV where a column has it, so that it isn't counted at each comparison."""
    n, hydro = F.length(seq), share(seq, "AILMFWV") if n_hydrophobic is None else F.try_divide(n_hydrophobic, F.length(seq))
    length = F.when(n.between(8, 16), 1.0).when(n.between(6, 20), 0.7).otherwise(0.3)
    balance = F.when(hydro.between(0.3, 0.6), 1.0).when(hydro.between(0.2, 0.7), 0.7).otherwise(0.4)
    ends = 0.35 * lookup(F.right(seq, F.lit(1)), S.TAP_C_TERMINAL, 0.4) + 0.15 * lookup(F.substring(seq, 2, 1), S.TAP_SECOND, 0.4)
    return F.when(n > 0, ends + 0.25 * length + 0.25 * balance).otherwise(F.lit(0.3))


def immunogenicity(seq: Column, class_one: Column, class_two: Column, tap: Column) -> Column:
    length = F.when(F.length(seq).between(8, 15), 1.0).otherwise(0.7)
    return 0.35 * clamp(class_one, 0.0, 1.0) + 0.35 * class_two + 0.20 * tap + 0.10 * length


def immunogenicity_error(allele: Column, rank: Column, ic50: Column) -> Column:
    """Why a row can't be scored for immunogenicity; null where it can."""
    return (
        F.when(F.coalesce(F.trim(allele), F.lit("")) == "", "no allele").when(ic50.isNotNull(), F.lit(None)).when(rank.isNull(), "no binding input")
        .when(~rank.between(0, 100), "rank outside 0 to 100")
    )


def rank_binding(rank: Column) -> Column:
    """Binding input from a percentile rank; null outside 0 to 100."""
    return F.when(rank.between(0, 100), 1.0 - rank / 100.0)


def estimate_ic50(seq: Column, allele: Column) -> Column:
    last, second = F.right(seq, F.lit(1)), F.when(F.length(seq) >= 2, F.substring(seq, 2, 1)).otherwise(F.right(seq, F.lit(1)))
    out = F.lit(500 / 0.51)
    for family, c_pref, p2_pref, base in reversed(S.ANCHOR_RULES):
        fit = (F.when(last.isin(*c_pref), 0.8).otherwise(0.3) + F.when(second.isin(*p2_pref), 0.8).otherwise(0.3)) / 2.0
        out = F.when(F.contains(F.upper(allele), F.lit(family)), F.lit(float(base)) / (0.01 + fit)).otherwise(out)
    return F.when(F.length(seq) > 0, out).otherwise(F.lit(99999.0))


def glycan_sites(seq: Column) -> Column:
    return F.regexp_count(seq, F.lit("N[^P][ST]"))


def bcell_immunogenicity(seq: Column, linear_score: Column) -> Column:
    return F.greatest(linear_score - F.least(glycan_sites(seq) * 0.15, F.lit(0.5)) - share(seq, "P") * 0.3, F.lit(0.0))


def conformational(seq: Column, n_domains: Column | int = 0) -> Column:
    domains = F.lit(n_domains) if isinstance(n_domains, int) else n_domains
    return F.coalesce(share(seq, "NDQEST"), F.lit(0.0)) * 0.7 + domains * 0.15 * 0.3


def charge_curve(seq: Column, ph: float = 7.0) -> Column:
    """Net charge at a pH by the dissociation of all residues and both ends; null for an empty sequence."""
    plus = F.lit(1 / (1 + 10 ** (ph - S.N_TERMINUS))) + sum(n_of(seq, a) * (1 / (1 + 10 ** (ph - pk))) for a, pk in S.BASES.items())
    minus = F.lit(1 / (1 + 10 ** (S.C_TERMINUS - ph))) + sum(n_of(seq, a) * (1 / (1 + 10 ** (pk - ph))) for a, pk in S.ACIDS.items())
    return F.when(F.length(seq) > 0, plus - minus)


def net_charge(seq: Column, ph: float = 7.0) -> Column:
    acid = {"D": 3.9, "E": 4.3, "C": 8.3, "Y": 10.1}
    base = {"H": 6.0, "K": 12.5, "R": 12.7}
    plus, minus = "".join(a for a, p in base.items() if ph < p), "".join(a for a, p in acid.items() if ph > p)
    return n_of(seq, plus) - n_of(seq, minus)


def aggregation_share(seq: Column) -> Column:
    """Share of five-residue windows with a summed hydropathy of 15 or more; for peptides, without an explode."""
    value = lambda aa: lookup(aa, S.AGGREGATION_HYDROPATHY, 0.0)
    n = F.length(seq)
    values = F.transform(F.split(seq, ""), value)
    sums = F.transform(F.sequence(F.lit(1), F.greatest(n - 4, F.lit(1))), lambda i: F.aggregate(F.slice(values, i, 5), F.lit(0.0), lambda a, x: a + x))
    hits = F.size(F.filter(sums, lambda x: x >= 15.0 - 1e-9))
    return F.when(n >= 5, hits / (n - 4)).otherwise(F.lit(0.0))


def solubility(seq: Column, aggregation: Column, ph: float = 7.0) -> Column:
    n = F.length(seq)
    gravy = F.try_divide(weighted(seq, S.HYDROPATHY), n)
    score = (
        0.25 * (1.0 - aggregation)
        + 0.25 * clamp(1.0 - F.greatest(gravy, F.lit(0.0)) / 5.0, 0.0, 1.0)
        + 0.25 * F.least(F.try_divide(F.abs(net_charge(seq, ph)), n) * 10.0, F.lit(1.0))
        + 0.25 * F.greatest(1.0 - n / 2000.0, F.lit(0.3))
    )
    return clamp(score, 0.0, 1.0)


IONIZABLE = {"D": 3.9, "E": 4.3, "H": 6.0, "C": 8.3, "Y": 10.1, "K": 12.5, "R": 12.7}


def stability(seq: Column, ph: float = 7.0, celsius: float = 25.0) -> Column:
    """Folding energy (kcal/mol): hydrophobic gain, less charged residues and length. Null for an empty sequence."""
    n = F.length(seq)
    charged = n_of(seq, "".join(aa for aa, pk in IONIZABLE.items() if pk != ph))
    energy = F.try_divide(weighted(seq, S.HYDROPATHY), n) * 0.5 * F.sqrt(n) - 0.05 * charged - 0.004 * n
    return energy * (1.0 - (celsius - 25.0) * 0.003)


def stability_class(energy: Column) -> Column:
    return F.when(energy > 0, "very_stable").when(energy > -5, "stable").when(energy > -10, "unstable").when(energy.isNotNull(), "very_unstable").otherwise("unknown")


def helix_score(seq: Column) -> Column:
    return F.try_divide(weighted(seq, S.HELIX_PROPENSITY, 1.0), F.length(seq))


def strand_aggregation(seq: Column) -> Column:
    """Aggregation from hydropathy and strand propensity, less charge; 0 for an empty sequence."""
    per_residue = lambda total: F.coalesce(F.try_divide(total, F.length(seq)), F.lit(0.0))
    value = per_residue(weighted(seq, S.HYDROPATHY)) * 0.4 + per_residue(weighted(seq, S.STRAND_PROPENSITY, 1.0)) * 0.3
    return clamp(value - F.coalesce(share(seq, "KRDE"), F.lit(0.0)) * 0.3, 0.0, 1.0)


def expression(solubility_score: Column, energy: Column, aggregation: Column) -> Column:
    """Expression likelihood; an unstable protein (-5 or less) counts a tenth of its energy."""
    folded = F.when(energy > -5, 0.7).otherwise(energy / -10.0)
    return clamp(solubility_score * 0.4 + folded * 0.3 + (1.0 - aggregation) * 0.3, 0.0, 1.0)


def instability(seq: Column, weights: dict[str, float]) -> Column:
    """``10 / n`` times the summed weights of adjacent residue pairs; ``weights`` (by pair) is the caller's table, other pairs count 0."""
    table = F.create_map(*[F.lit(x) for pair, w in weights.items() for x in (pair, float(w))])
    pairs = F.regexp_extract_all(seq, F.lit("(?=(..))"), F.lit(1))
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, pair: acc + F.coalesce(F.try_element_at(table, pair), F.lit(0.0)))
    return F.try_divide(total * 10.0, F.length(seq))


def physicochemical(seq: Column) -> dict[str, Column]:
    """The properties that follow from residue counts."""
    n = F.length(seq)
    return {
        "molecular_weight": weighted(seq, S.WEIGHTS) - 18.015 * (n - 1),
        "gravy": F.try_divide(weighted(seq, S.HYDROPATHY), n),
        "aromaticity": share(seq, "FWY"),
        "extinction": 5500 * n_of(seq, "W") + 1490 * n_of(seq, "Y") + 125 * n_of(seq, "C"),
        "aliphatic": F.try_divide(100.0 * (n_of(seq, "A") + 4.2 * n_of(seq, "V") + 4.5 * n_of(seq, "I") + 3.8 * n_of(seq, "L")), n),
    }


def codons(dna: Column) -> Column:
    n = F.floor(F.length(dna) / 3).cast("int")
    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substr(dna, i * 3 + 1, F.lit(3)))).otherwise(
        F.array().cast("array<string>")
    )


def gc_percent(dna: Column) -> Column:
    return F.coalesce(F.try_divide(n_of(dna, "GC") * 100.0, F.length(dna)), F.lit(0.0))


def rare_codons(dna: Column) -> Column:
    return F.filter(codons(dna), lambda c: c.isin("AGG", "AGA", "CGG", "CGA"))


def translated(dna: Column) -> Column:
    """The protein of the first reading frame by the standard code; ``*`` stops, ``X`` is no codon of the four letters."""
    table = F.create_map(*[F.lit(x) for pair in S.GENETIC_CODE.items() for x in pair])
    return F.array_join(F.transform(codons(dna), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")


def adaptation(dna: Column, organism: str = "e coli") -> Column:
    """Codon adaptation estimate: 0.3 + 0.4 * share of codons that match the organism's patterns; 0.5 without a codon."""
    patterns = "^(" + "|".join(S.ADAPTED_CODONS.get(organism, S.ADAPTED_CODONS["e coli"])).replace("X", ".") + ")$"
    good = F.size(F.filter(codons(dna), lambda c: c.rlike(patterns)))
    return F.when(F.length(dna) >= 3, 0.3 + 0.4 * good / F.size(codons(dna))).otherwise(F.lit(0.5))


def positional_identity(a: Column, b: Column) -> Column:
    """Percent of equal positions over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0))), F.lit(0), lambda s, x: s + x)
    return F.when(n > 0, same * 100.0 / n).otherwise(F.lit(0.0))
