"""Structure operators: contacts, contact quality and energy, disulfide pairs, angles, restriction sites."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.functions import scales as S
from sieveline.functions.helpers import words_of

from .residues import residues, secondary_states


def ca_contacts(atoms: DataFrame, cutoff: float = 8.0, least_separation: int = 3) -> DataFrame:
    """Residue pairs of a structure within the cutoff and at least ``least_separation`` apart.

    Residues fall into grid cells as wide as the cutoff; each is copied to the 27 cells around its own
    and joined on structure and cell, so only near residues meet.
    """
    cell = lambda c: F.floor(F.col(c) / cutoff)
    placed = atoms.select("structure_id", "res_idx", "aa", "x", "y", "z", cell("x").alias("cx"), cell("y").alias("cy"), cell("z").alias("cz"))
    near = F.sequence(F.lit(-1), F.lit(1))
    around = placed
    for c in ("cx", "cy", "cz"):
        around = around.withColumn("d", F.explode(near)).withColumn(c, F.col(c) + F.col("d")).drop("d")
    names = {"res_idx": "j", "aa": "aa_j", "x": "xj", "y": "yj", "z": "zj"}
    right = around.withColumnsRenamed(names)
    left = placed.withColumnsRenamed({"res_idx": "i", "aa": "aa_i"})
    pairs = left.join(right, ["structure_id", "cx", "cy", "cz"]).filter(F.col("j") - F.col("i") >= least_separation)
    d2 = reduce(add, [F.pow(F.col(a) - F.col(b), 2) for a, b in (("x", "xj"), ("y", "yj"), ("z", "zj"))])
    return pairs.filter(d2 <= cutoff * cutoff).select("structure_id", "i", "j", "aa_i", "aa_j", d2.alias("d2"))


def _pair(contacts: DataFrame) -> DataFrame:
    low, high = F.least("aa_i", "aa_j"), F.greatest("aa_i", "aa_j")
    return contacts.withColumn("pair", F.concat(low, high))


def _pair_value(values: dict[str, float], default: float) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.element_at(table, F.col("pair")), F.lit(default))


def contact_quality(contacts: DataFrame) -> DataFrame:
    """Per structure: contacts, bad and good weight, and quality from 0 to 100."""
    expected = _pair_value(S.CONTACT_EXPECTED, 1.0)
    ratio = F.least(1.0 / expected, expected, F.lit(1.0))
    bad = F.when(ratio < 0.6, 1.0 - ratio).otherwise(F.lit(0.0))
    good = F.when(ratio < 0.6, F.lit(0.0)).otherwise(ratio)
    sums = _pair(contacts).groupBy("structure_id").agg(F.count("*").alias("contacts"), F.sum(bad).alias("bad"), F.sum(good).alias("good"))
    return sums.withColumn("quality", F.least(F.greatest((F.col("contacts") - F.col("bad")) / F.col("contacts") * 100, F.lit(0.0)), F.lit(100.0)))


def contact_energy(contacts: DataFrame) -> DataFrame:
    """Per structure: mean pair energy, its z-score, violations over 1.0 and whether it looks native."""
    energy = _pair_value(S.CONTACT_ENERGY, 0.0)
    sums = _pair(contacts).withColumn("e", energy).groupBy("structure_id").agg(
        F.avg("e").alias("energy"), F.count_if(F.col("e") > 1.0).alias("violations"), F.count("*").alias("pairs")
    )
    sums = sums.withColumn("z_score", (F.col("energy") + 0.5) / 0.3)
    return sums.withColumn("native_like", F.col("z_score").between(-4.0, 3.0) & (F.col("violations") < 0.3 * F.col("pairs")))


def disulfide_pairs(proteins: DataFrame, least: int = 10, most: int = 80, top: int = 8, places: DataFrame | None = None) -> DataFrame:
    """The best residue pairs of each protein for a disulfide bond: ordered neighbourhoods, separation of 10 to 79.

    A pair scores the share of helix or sheet among the seven residues around either end, and 4 more
    up to a separation of 40. Only pairs of the best class can reach the top, so positions are ranked
    per protein after a linear explode; there is no self-join over pairs.

    places: proteome_id, ord, pos, x, y, z of residues (some may be missing); a pair 3 to 9 apart gets up to 1 more, most at 6.
    """
    key = ["proteome_id", "ord"]
    w = Window.partitionBy(*key).orderBy("pos").rowsBetween(-3, 3)
    states = secondary_states(residues(proteins)).select(*key, "pos", "n", "aa", "state")
    order = F.avg(F.col("state").isin("H", "E").cast("double")).over(w)
    ends = states.withColumn("order", order).filter("aa <> 'C'").select(*key, "pos", "n", "order")
    last = F.least(F.col("pos") + most - 1, F.col("n"))
    begin = F.col("pos") + least
    at = ("x", "y", "z")
    if places is None:
        ends = ends.withColumns({c: F.lit(None).cast("double") for c in at})
    else:
        ends = ends.join(places.select(*key, "pos", *at), [*key, "pos"], "left")
    left = ends.filter(last >= begin).select(*key, F.col("pos").alias("i"), F.col("order").alias("order_i"), F.explode(F.sequence(begin, last)).alias("j"), *[F.col(c).alias(f"{c}_i") for c in at])
    pairs = left.join(ends.select(*key, F.col("pos").alias("j"), F.col("order").alias("order_j"), *[F.col(c).alias(f"{c}_j") for c in at]), [*key, "j"])
    distance = F.sqrt(sum((F.pow(F.col(f"{c}_i") - F.col(f"{c}_j"), 2) for c in at), F.lit(0.0)))
    boost = F.coalesce(F.when(distance.between(3.0, 9.0), 1.0 - F.abs(distance - 6.0) / 3.0), F.lit(0.0))
    score = F.round(F.col("order_i") + F.col("order_j") + F.when(F.col("j") <= F.col("i") + 40, 4.0).otherwise(0.0) + boost, 3)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("score").desc(), "i", "j"))
    return pairs.withColumn("score", score).withColumn("rank", rank).filter(F.col("rank") <= top).select(*key, "rank", "i", "j", "score")


def inferred_contacts(proteins: DataFrame) -> DataFrame:
    """Sequence-only contacts: positions three and four apart, and hydrophobic residues more than five apart.

    The latter are as many as the square of the length: for constructs and the like. For whole
    proteomes ``inferred_contact_counts`` has their number in linear time.
    """
    key = ["proteome_id", "ord"]
    w = Window.partitionBy(*key).orderBy("pos")
    res = residues(proteins).select(*key, "pos", "aa")
    both = res.withColumns({"a3": F.lead("aa", 3).over(w), "a4": F.lead("aa", 4).over(w)})
    parts = F.array(*[F.struct((F.col("pos") + k).alias("j"), F.col(f"a{k}").alias("aa_j")) for k in (3, 4)])
    out = both.select(*key, F.col("pos").alias("i"), F.col("aa").alias("aa_i"), F.explode(parts).alias("p")).filter("p.aa_j IS NOT NULL")
    local = out.select(*key, "i", F.col("p.j").alias("j"), "aa_i", F.col("p.aa_j").alias("aa_j"))
    packed = proteins.select(*key, F.filter(F.transform(F.split("sequence", ""), _hydrophobic_place), lambda p: p.isNotNull()).alias("places"))
    far = packed.select(*key, "places", F.explode("places").alias("x"))
    far = far.select(*key, "x", F.explode(F.filter("places", lambda y: y["pos"] > F.col("x.pos") + 5)).alias("y"))
    return local.union(far.select(*key, F.col("x.pos").alias("i"), F.col("y.pos").alias("j"), F.col("x.aa").alias("aa_i"), F.col("y.aa").alias("aa_j")))


CORE = "AILVFMWP"


def _hydrophobic_place(aa: Column, i: Column) -> Column:
    return F.when(aa.isin(*CORE), F.struct((i + 1).alias("pos"), aa.alias("aa")))


def inferred_contact_counts(proteins: DataFrame) -> DataFrame:
    """Local and hydrophobic contacts of each protein, counted without listing them.

    Hydrophobic pairs more than five apart are all such pairs less those one to five apart.
    """
    n, core = F.length("sequence"), F.length("sequence") - F.length(F.translate("sequence", CORE, ""))
    near = sum((F.regexp_count("sequence", F.lit(f"(?=[{CORE}].{{{d - 1}}}[{CORE}])")) for d in range(1, 6)), F.lit(0))
    core = core.cast("long")
    local = F.greatest(n - 3, F.lit(0)) + F.greatest(n - 4, F.lit(0))
    return proteins.select("proteome_id", "ord", local.cast("long").alias("local"), F.floor(core * (core - 1) / 2 - near).cast("long").alias("hydrophobic"))


def ramachandran_summary(angles: DataFrame) -> DataFrame:
    """Favored, allowed and outlier residues of each structure from phi and psi (degrees)."""
    w = Window.partitionBy("structure_id").orderBy("res_idx")
    kind = F.when(F.col("aa") == "G", "gly").when(F.lead("aa").over(w) == "P", "pre").when(F.col("aa") == "P", "pro").otherwise("other")
    phi, psi, c = F.col("phi"), F.col("psi"), F.col("kind")
    favored = (
        F.when(c == "gly", phi.between(-120, -30) & psi.between(-70, 30)).when(c == "pre", phi.between(-90, -30) & psi.between(-80, 20))
        .otherwise(phi.between(-90, -30) & psi.between(-70, 30))
    )
    allowed = (
        F.when(c == "gly", phi.between(-180, 180) & psi.between(-180, 180)).when(c == "pro", phi.between(-90, -30) & psi.between(-90, 30))
        .when(c == "pre", phi.between(-90, -30) & psi.between(-90, 40)).otherwise(phi.between(-180, -30) & psi.between(-180, 30))
    )
    judged = angles.withColumn("kind", kind).withColumns({"f": favored, "a": ~favored & allowed})
    return judged.groupBy("structure_id").agg(
        F.count("*").alias("residues"), F.count_if("f").alias("favored"), F.count_if("a").alias("allowed"),
        F.count_if(~F.col("f") & ~F.col("a")).alias("outlier"),
    )


def coordinate_summary(atoms: DataFrame, contacts: DataFrame) -> DataFrame:
    """Structures, residues and contacts in all; structures without any coordinates count as failures, ``source`` (if there) as sources."""
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    a = atoms.agg(
        F.count_distinct("structure_id").alias("structures"), F.count("*").alias("residues"),
        (F.count_distinct("structure_id") - F.count_distinct(F.when(placed, F.col("structure_id")))).alias("failures"),
        F.count_distinct("source" if "source" in atoms.columns else F.lit(None).cast("string")).alias("sources"),
    )
    c = contacts.agg(F.count("*").alias("contacts"), F.count_distinct("structure_id").alias("with_contacts"))
    return a.join(F.broadcast(c))  # one row each


def restriction_sites(dna: DataFrame, enzymes: tuple[tuple[str, str], ...] = S.ENZYMES) -> DataFrame:
    """All overlapping enzyme sites with their 0-based positions."""
    table = F.array(*[F.struct(F.lit(n).alias("enzyme"), F.lit(s).alias("site"), F.lit(i).alias("enzyme_ord")) for i, (n, s) in enumerate(enzymes)])
    each = dna.select("id", "dna", F.explode(table).alias("e")).filter(F.contains("dna", F.col("e.site")))
    parts = words_of(F.col("dna"), F.length("e.site"))
    return each.select("id", "e.enzyme", "e.enzyme_ord", "e.site", F.posexplode(parts).alias("position", "part")).filter("part = site").drop("site", "part")


def usable_enzymes(vectors: DataFrame, inserts: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each (vector, insert): up to two enzymes that cut the vector and not the insert.

    The first two with two vector sites or more in catalogue order; without two such, those with one.
    """
    cuts = restriction_sites(vectors).groupBy("id", "enzyme", "enzyme_ord").agg(F.count("*").alias("n")).withColumnRenamed("id", "vector_id")
    inside = restriction_sites(inserts).select(F.col("id").alias("insert_id"), "enzyme").distinct()
    free = pairs.join(cuts, "vector_id").join(inside, ["insert_id", "enzyme"], "left_anti")
    many = free.groupBy("vector_id", "insert_id").agg(F.count_if(F.col("n") >= 2).alias("many"))
    kept = free.join(many, ["vector_id", "insert_id"]).filter(F.when(F.col("many") >= 2, F.col("n") >= 2).otherwise(F.col("n") == 1))
    rank = F.row_number().over(Window.partitionBy("vector_id", "insert_id").orderBy("enzyme_ord"))
    return kept.withColumn("rank", rank).filter("rank <= 2").select("vector_id", "insert_id", "rank", "enzyme", "n")


def mean_confidence(records: DataFrame) -> DataFrame:
    """Mean of the numeric per-residue confidences, else the global metric, else null."""
    numbers = F.filter(F.transform("confidences", lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    mean = F.when(F.size(numbers) > 0, F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / F.size(numbers))
    return records.select("structure_id", F.coalesce(mean, F.col("global_metric")).alias("confidence"))
