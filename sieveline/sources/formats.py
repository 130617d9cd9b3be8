"""Readers and writers of the exchange formats: FASTA, tabular hits, prediction tables, annotations, reports.

Readers take paths and return typed DataFrames; rows that don't parse drop out as stated. Records are
split by Spark's text reader with a record separator, so large plain files are read in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import numbered

HIT_LAYOUTS = {
    7: "qseqid string, sseqid string, stitle string, pident double, evalue double, length int, bitscore double",
    10: "qseqid string, sseqid string, pident double, length int, qstart int, qend int, sstart int, send int, evalue double, bitscore double",
    12: "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double",
}
RANK_COLUMNS = ("consensus_percentile_rank", "percentile_rank", "rank", "adjusted_rank")
#: headers of the epitope exchange file behind the row number, and the columns that they show: a fixed format
EPITOPE_COLUMNS = (
    ("Type", "type"), ("Sequence", "sequence"), ("Source Protein", "protein_name"), ("Source Protein ID", "accession"), ("Position", "start"),
    ("Window", "window"), ("HLA Allele", "allele"), ("Method", "method"), ("Provenance", "provenance"), ("IC50 (nM)", "ic50"),
    ("Percentile Rank", "percentile"), ("Antigenicity", "antigenicity"), ("Immunogenicity", "immunogenicity"), ("Toxic", "is_toxic"),
    ("Allergenic", "is_allergenic"), ("Selected", "selected"),
)
LABELS = (
    "Cell-wall-anchored", "Cell Wall Anchored", "Wall anchored", "CellWall/Extracellular", "CellWall/Membrane", "CytoplasmicMembrane",
    "Outer membrane", "OuterMembrane", "Lipoprotein", "Extracellular", "CellWall", "Secreted", "Cytoplasmic",
)


def read_fasta(spark: SparkSession, path: str, proteome_id: str | None = None) -> DataFrame:
    """FASTA records; ``>sp|ACC|NAME`` or ``>tr|ACC|NAME`` gives accession, name and reviewed, else accession ``?``."""
    raw = spark.read.option("lineSep", "\n>").text(path).withColumn("value", F.regexp_replace("value", r"^>", ""))
    header = F.trim(F.substring_index("value", "\n", 1))
    body = F.when(F.contains("value", F.lit("\n")), F.regexp_replace("value", r"^[^\n]*\n", "")).otherwise("")
    known = header.rlike(r"^(sp|tr)\|[^|]*\|\S")
    return raw.filter(F.trim("value") != "").select(
        F.lit(proteome_id).alias("proteome_id"),
        F.when(known, F.regexp_extract(header, r"^(?:sp|tr)\|([^|]*)\|", 1)).otherwise("?").alias("accession"),
        F.when(known, F.regexp_extract(header, r"^(?:sp|tr)\|[^|]*\|(\S+)", 1)).otherwise(header).alias("name"),
        F.regexp_replace(body, r"\s", "").alias("sequence"),
        header.startswith("sp|").alias("reviewed"),
    )


def strict_fasta(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): a record without accession or sequence is quarantined."""
    bad = (F.col("accession") == "?") | (F.col("sequence") == "")
    return records.filter(~bad), records.filter(bad)


def fasta_lines(header: Column, sequence: Column, width: int = 60) -> Column:
    return F.concat(F.lit(">"), header, F.lit("\n"), F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n"))


def write_fasta(records: DataFrame, path: str, header: Column, sequence: str = "sequence") -> None:
    records.select(fasta_lines(header, F.col(sequence)).alias("value")).write.text(path)


def write_genbank(constructs: DataFrame, path: str) -> None:
    """Flat records with origin lines of 60 residues."""
    length = F.length("construct").cast("string")
    lines = F.concat_ws(
        "\n", F.concat(F.lit("LOCUS       "), F.col("run_id"), F.lit("  "), length, F.lit(" aa")), F.lit("DEFINITION  Multi-epitope construct"), F.lit("ORIGIN"),
        F.regexp_replace("construct", "(.{60})(?=.)", "$1\n"), F.lit("//"),
    )
    constructs.select(lines.alias("value")).write.text(path)


def read_hits(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Tabular hits of 7, 10 or 12 columns; lines that don't parse drop out; subject accession is the last part of its id."""
    rows = spark.read.csv(path, sep="\t", schema=HIT_LAYOUTS[columns], encoding="ISO-8859-1", mode="DROPMALFORMED")
    return rows.withColumn("query_id", F.substring_index("qseqid", "|", 1)).withColumn("accession", F.element_at(F.split("sseqid", r"\|"), -1))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Binding predictions with a header; the rank is the first of four columns that parses."""
    raw = spark.read.csv(path, sep="\t", header=True)
    number = lambda c, kind: F.col(c).try_cast(kind) if c in raw.columns else F.lit(None).cast(kind)
    core = F.coalesce(*[F.nullif(F.col(c), F.lit("-")) for c in ("core", "core_peptide") if c in raw.columns], F.lit(None).cast("string"))
    out = raw.select(
        "allele", *[number(c, "int").alias(c) for c in ("seq_num", "start", "end", "length")], "peptide", core.alias("core"),
        number("score", "double").alias("score"), F.coalesce(*[number(c, "double") for c in RANK_COLUMNS]).alias("percentile"),
    )
    return out.dropna(subset=["seq_num", "start", "end", "length"])


def remap_seq_num(predictions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Request-local ``seq_num`` 1..n to the global query index of its batch; out-of-range ones drop out."""
    joined = predictions.join(manifest, "batch")
    return joined.filter(F.col("seq_num").between(1, F.col("batch_size"))).withColumn("query_index", F.col("offset") + F.col("seq_num")).drop("offset", "batch_size")


def read_essential_annotation(spark: SparkSession, path: str, organism: str | None = None, entry: str | None = None) -> DataFrame:
    """Semicolon annotation: entry, gene, locus, product and organism of ``GI:`` rows; the last row of a GI wins."""
    names = "entry gene_ref gi locus symbol product cog function organism".split()
    raw = spark.read.csv(path, sep=";", quote='"', schema=", ".join(f"{n} string" for n in names)).withColumn("ord", F.monotonically_increasing_id())
    rows = raw.filter(F.col("organism").isNotNull() & F.col("gi").startswith("GI:"))
    if organism is not None:
        rows = rows.filter(F.contains("organism", F.lit(organism)))
    if entry is not None:
        rows = rows.filter(F.col("entry") == entry)
    rows = rows.withColumn("gi", F.regexp_replace("gi", r"\D", "").try_cast("long"))
    last = F.row_number().over(Window.partitionBy("gi").orderBy(F.col("ord").desc()))
    return rows.withColumn("rank", last).filter("rank = 1").drop("rank", "ord")


def read_localization(spark: SparkSession, path: str) -> DataFrame:
    """Terse localization rows: id, known label or first token, last number as score."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|SeqID|$)"))
    known = "(?i)(?<![A-Za-z])(" + "|".join(LABELS) + ")(?![A-Za-z])"
    rest = F.regexp_replace("value", r"^\S+\s+", "")
    label = F.regexp_extract(rest, known, 1)
    numbers = F.regexp_extract_all(rest, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    return lines.select(
        F.regexp_extract("value", r"^(\S+)", 1).alias("protein_id"),
        F.when(label != "", label).otherwise(F.regexp_extract(rest, r"^(\S+)", 1)).alias("label"),
        F.get(numbers, F.size(numbers) - 1).try_cast("double").alias("score"),
    )


def read_topology(spark: SparkSession, path: str) -> DataFrame:
    """Feature tables split at ``//``: id, last signal, membrane regions and domains."""
    records = spark.read.option("lineSep", "//\n").text(path).filter(F.trim("value") != "")
    lines = records.select(F.regexp_extract("value", r"ID\s+(\S+)", 1).alias("protein_id"), F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    feature = lambda i: F.regexp_extract("line", r"^FT\s+(\S+)\s+(\d+)\s+(\d+)\s*(.*)$", i)
    region = F.struct("pos", feature(2).try_cast("int").alias("start"), feature(3).try_cast("int").alias("end"), F.trim(feature(4)).alias("description"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(feature(1) == kind, region)))
    grouped = lines.groupBy("protein_id").agg(of("SIGNAL").alias("signals"), of("TRANSMEM").alias("tm"), of("DOMAIN").alias("domains"))
    return grouped.select("protein_id", F.get("signals", F.size("signals") - 1).alias("signal"), "tm", "domains")


def read_ca_atoms(spark: SparkSession, path: str, id_in_path: str = r"([^/]+)$") -> DataFrame:
    """C-alpha atoms of the first model of coordinate files, by fixed columns; the id comes from the file's path."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    files = files.select(F.regexp_extract(F.input_file_name(), id_in_path, 1).alias("structure_id"), "value")
    first = F.substring_index("value", "\nENDMDL", 1)
    lines = files.select("structure_id", F.posexplode(F.split(first, "\n")).alias("pos", "line"))
    cut = lambda at, n: F.trim(F.substring("line", at, n))
    atoms = lines.filter(F.substring("line", 1, 4).isin("ATOM") & (cut(13, 4) == "CA"))
    three = dict(zip("ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split(), "ARNDCQEGHILKMFPSTWYV", strict=True))
    residue = F.element_at(F.create_map(*[F.lit(x) for p in three.items() for x in p]), cut(18, 3))
    return atoms.select(
        "structure_id", F.row_number().over(Window.partitionBy("structure_id").orderBy("pos")).alias("res_idx"), residue.alias("aa"),
        *[cut(at, 8).try_cast("double").alias(c) for at, c in ((31, "x"), (39, "y"), (47, "z"))],
    ).filter("aa IS NOT NULL")


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


ROWS_A_PARTITION = 100_000


def read_jobs_jdbc(spark: SparkSession, url: str, table: str, schema: str, column: str = "document", key: str = "id", rows_a_partition: int = ROWS_A_PARTITION, quote: str = '"') -> DataFrame:
    """Job documents from a JSON column of a SQL table, parsed with a schema, with their ``key``.

    The table is read in ranges of its numeric key, as many as its rows ask for; their bounds come from one query. Filters on the key reach the database.
    quote: what the database puts around names. Rows with a null key come with the first range.
    """
    of = lambda query: spark.read.format("jdbc").options(url=url, **query)
    key = next(c for c in of({"dbtable": table}).load().columns if c.lower() == key.lower())
    name = f"{quote}{key}{quote}"
    low, high, n = of({"query": f"SELECT MIN({name}) AS low, MAX({name}) AS high, COUNT(*) AS n FROM {table}"}).load().first()
    ranges = {"partitionColumn": key, "lowerBound": low, "upperBound": high + 1, "numPartitions": -(-n // rows_a_partition)} if n and low is not None else {}
    rows = of({"dbtable": table, **ranges}).load()
    return rows.select(key, F.from_json(column, schema).alias("job")).select(key, "job.*")


def write_epitope_csv(epitopes: DataFrame, path: str) -> None:
    """Epitope rows with their number in the run (``#``) in the order of ids and Yes/No flags; what the rows don't have is empty, quotes are doubled."""
    flags = ("is_toxic", "is_allergenic", "selected")
    there = epitopes if "protein_name" in epitopes.columns else epitopes.withColumn("protein_name", F.col("accession"))

    def shown(column: str) -> Column:
        value = F.col(column) if column in there.columns else F.lit(None)
        return F.when(value.cast("boolean"), "Yes").otherwise("No") if column in flags else value.cast("string")

    columns = [shown(column).alias(header) for header, column in EPITOPE_COLUMNS]
    there = numbered(there, "run_id", "id", "#")
    there.select("run_id", "#", *columns).write.option("header", True).option("escape", '"').csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def read_coverage_lines(spark: SparkSession, path: str) -> DataFrame:
    """``area  coverage%  hit  pc90`` lines; summary lines drop out."""
    rx = r"^\s*(\S.*?)\s{2,}([\d.]+)%\s+([\d.]+)\s+([\d.]+)\s*$"
    lines = spark.read.text(path).filter(F.col("value").rlike(rx) & ~F.lower("value").rlike(r"^\s*(average|standard)"))
    part = lambda i: F.regexp_extract("value", rx, i)
    return lines.select(part(1).alias("area"), *[part(i).cast("double").alias(c) for i, c in ((2, "coverage"), (3, "hit"), (4, "pc90"))])
