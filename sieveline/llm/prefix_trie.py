"""Trie of conversation prefixes by whole-sequence collapse (operator 11).

Conversations with identical turns collapse into one weighted sequence with a list of those that end
there. Sequences that are proper prefixes of others are found by an anti-join against the parents of
nodes; the others are leaves. Prefixes of the weighted sequences then aggregate to nodes.

A prefix is known by its length and two 64-bit sums (exclusive or) of hashes of place and turn digest, 128
bits in all, so that no conversation is gathered in one row: places and prefixes are running sums in
blocks, with the totals of earlier blocks added. What a whole subtree saves needs no walk over the
tree: each node belongs to the path of its smallest member, which owns the lower end of its own path
from some depth on, so the subtree's sum is a sum over paths of what lies behind that depth.

Edge cases: rows with a null conv_id take no part; a null role or text is empty; turns with equal
numbers, null ones included, come by the digest of role and text, and equal rows count each; an empty
table gives an empty result; further columns are ignored.

Limit: SHA-256 of a list of members reads it in order, so one task streams the list of one sequence, in
pieces of at most ``2 ** LIST_BITS`` ids; it never holds it whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_sql, read_table, written

FAMILY = 5
HEADS = 9
BLOCK = 4096
LIST_BITS = 12
EMPTY_LIST = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0 in the order of turns), digest, n_bytes.

    Rows are dealt out by ranges, so a long conversation lies in several blocks, each counted on its own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.asc_nulls_first("turn"), "digest", "row"]
    turns = written(turns.repartitionByRange("conv_id", *order).withColumn("block", F.spark_partition_id()), "trie-turns")
    within = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order)) - 1
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = turns.groupBy("conv_id", "block").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(earlier)).filter("before > 0")
    placed = turns.withColumn("at", within).join(starts.select("conv_id", "block", "before"), ["conv_id", "block"], "left")
    return placed.select("conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "n_bytes")


def rebuilt_turns(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first of their family: (all conv_ids, their turns by pos).

    The first h turns come from conversation ``c - c % FAMILY``, the rest from c behind its own first h; h is a hash of c.
    """
    counts = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = F.when(first == F.col("conv_id"), 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
    convs = counts.select("conv_id", first.alias("first_id"), h.alias("h"))
    firsts = counts.select(F.col("conv_id").alias("first_id"), F.col("n").alias("n_first"))
    convs = written(convs.join(firsts, "first_id", "left").withColumn("taken", F.least("h", F.coalesce("n_first", F.lit(0)))).drop("n_first"), "trie-convs")
    own = placed.join(convs, "conv_id").filter("pos >= h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "digest", "n_bytes")
    heads = placed.filter((F.col("pos") < HEADS - 1) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "first_id")
    taken = heads.join(convs, "first_id").filter("pos < h").select("conv_id", "pos", "digest", "n_bytes")
    return convs.select("conv_id"), own.unionByName(taken)


def _hashed() -> list[Column]:
    return [F.xxhash64("pos", "digest").alias("gx"), F.xxhash64("digest", "pos", F.lit("second")).alias("gy")]


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined lists; pieces of a key follow each other in order."""
    key, digest = None, None
    for batch in batches:
        done = []
        for *new, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if new != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = new, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield _lists(done)
    if key is not None:
        yield _lists([(*key, digest.hexdigest())])


def _lists(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["depth", "x", "y", "ends_sha256"])


KEY = ["depth", "x", "y"]


def sequences(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Whole sequences: key, rep (smallest member), weight (members), total (bytes), ends_sha256 of its sorted members."""
    turns = turns.select("conv_id", "n_bytes", *_hashed())
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("depth"), F.bit_xor("gx").alias("x"), F.bit_xor("gy").alias("y"), F.sum("n_bytes").alias("total"))
    whole = convs.join(whole, "conv_id", "left").na.fill(0)
    lists = whole.groupBy(*KEY, F.shiftright("conv_id", LIST_BITS).alias("piece")).agg(
        F.concat_ws(",", F.sort_array(F.collect_list("conv_id"))).alias("ids"), F.count("*").alias("n"), F.min("conv_id").alias("rep"), F.first("total").alias("total"),
    )
    lists = written(lists, "trie-lists")
    made = lists.groupBy(*KEY).agg(
        F.min("rep").alias("rep"), F.sum("n").alias("weight"), F.first("total").alias("total"), F.count("*").alias("pieces"), F.min("ids").alias("ids"),
    )
    made = written(made, "trie-collapsed")
    several = lists.join(made.filter("pieces > 1").select(*KEY), KEY, "left_semi").repartition(*KEY).sortWithinPartitions(*KEY, "piece")
    streamed = several.select(*KEY, "ids").mapInArrow(_hash_lists, "depth long, x long, y long, ends_sha256 string")
    single = made.filter("pieces = 1").withColumn("ends_sha256", F.sha2("ids", 256))
    both = single.unionByName(made.filter("pieces > 1").join(streamed, KEY))
    return written(both.drop("pieces", "ids"), "trie-sequences")


def prefixes(seqs: DataFrame, turns: DataFrame) -> DataFrame:
    """Every prefix of every sequence: rep, key, px and py (the parent's), n_bytes of its last turn, cum (bytes of the whole prefix)."""
    lengths = seqs.select(F.col("rep").alias("conv_id"), F.col("depth").alias("length"))
    turns = turns.join(lengths, "conv_id").select("conv_id", "pos", "n_bytes", "length", F.floor(F.col("pos") / BLOCK).alias("block"), *_hashed())
    so_far = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    within = turns.withColumns({"wx": F.bit_xor("gx").over(so_far), "wy": F.bit_xor("gy").over(so_far), "wc": F.sum("n_bytes").over(so_far)})
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    long = turns.filter(F.col("length") > BLOCK).groupBy("conv_id", "block")
    long = long.agg(F.bit_xor("gx").alias("bx"), F.bit_xor("gy").alias("by"), F.sum("n_bytes").alias("bc"))
    starts = long.select("conv_id", "block", F.bit_xor("bx").over(earlier).alias("ex"), F.bit_xor("by").over(earlier).alias("ey"), F.sum("bc").over(earlier).alias("ec"))
    all_of = within.join(starts.filter("ec IS NOT NULL"), ["conv_id", "block"], "left").na.fill(0, ["ex", "ey", "ec"])
    x, y = F.col("wx").bitwiseXOR(F.col("ex")), F.col("wy").bitwiseXOR(F.col("ey"))
    made = all_of.select(
        F.col("conv_id").alias("rep"), (F.col("pos") + 1).cast("long").alias("depth"), x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("gx")).alias("px"), y.bitwiseXOR(F.col("gy")).alias("py"),
        "n_bytes", (F.col("wc") + F.col("ec")).alias("cum"),
    )
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    roots = seqs.select("rep", zero.alias("depth"), zero.alias("x"), zero.alias("y"), none.alias("px"), none.alias("py"), zero.alias("n_bytes"), zero.alias("cum"))
    return written(made.unionByName(roots), "trie-prefixes")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    convs: all conv_ids, also those without turns; turns: conv_id, pos (from 0, without gaps), digest, n_bytes.
    """
    turns = written(turns, "trie-rebuilt")
    seqs = sequences(convs, turns)
    paths = prefixes(seqs, turns)
    before = F.col("cum") - F.col("n_bytes")
    owners = written(paths.groupBy(*KEY).agg(F.min("rep").alias("conv_id"), F.first("px").alias("px"), F.first("py").alias("py"), F.first(before).alias("before")), "trie-owners")
    parents = owners.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    parents = written(parents, "trie-parents")
    leaves = seqs.join(parents, KEY, "left_anti").select("rep", F.lit(1).alias("leaf"))
    owned = owners.groupBy(F.col("conv_id").alias("rep")).agg(F.min("before").alias("own_from"))  # a path owns all from there down
    weighted = seqs.select("rep", "weight", "total").join(owned, "rep", "left").join(leaves, "rep", "left")
    saved = F.col("weight") * (F.col("total") - before) - (F.col("total") - F.greatest(before, F.coalesce("own_from", "total")))
    sums = paths.join(weighted, "rep").groupBy(*KEY).agg(
        F.sum("weight").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(saved).alias("saved_tokens"),
    )
    above = owners.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    nodes = sums.join(owners.drop("before"), KEY).join(parents, KEY, "left").join(seqs.select(*KEY, "ends_sha256"), KEY, "left")
    nodes = nodes.join(above, ["depth", "px", "py"], "left")
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_LIST)).alias("ends_sha256"),
    )


def leaf_sequences(conversations: DataFrame) -> DataFrame:
    """The sequences to train on, each written once: conv_id (of the leaf), pos, role, text, n_convs that pass here, n_ends that end here.

    A turn belongs to the leaf with the smallest conv_id among those that pass it, so every node comes once.
    """
    placed = written(placed_turns(conversations), "trie-placed")
    convs = placed.select("conv_id").distinct()
    seqs = sequences(convs, placed)
    paths = prefixes(seqs, placed)
    parents = paths.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).distinct()
    leaves = seqs.join(parents, KEY, "left_anti").select("rep", F.col("rep").alias("leaf"))
    nodes = paths.join(seqs.select("rep", "weight"), "rep").join(leaves, "rep", "left").groupBy(*KEY).agg(F.sum("weight").alias("n_convs"), F.min("leaf").alias("conv_id"))
    nodes = nodes.filter("depth > 0").join(seqs.select(*KEY, F.col("weight").alias("n_ends")), KEY, "left").withColumn("pos", F.col("depth") - 1)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    texts = conversations.select(turn_digest(role, text).alias("digest"), role.alias("role"), text.alias("text")).dropDuplicates(["digest"])
    return nodes.join(placed.select("conv_id", "pos", "digest"), ["conv_id", "pos"]).join(texts, "digest").select("conv_id", "pos", "role", "text", "n_convs", F.coalesce("n_ends", F.lit(0)).alias("n_ends"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = written(placed_turns(read_table(spark, sf_dir, "conversations")), "trie-placed")
    return prefix_trie(*rebuilt_turns(placed))


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
ORACLE_SQL = {
    "op11_prefix_trie": f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS first_id, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE {crc32_sql("conv_id::varchar")} % 9 END AS h FROM (SELECT DISTINCT conv_id FROM t)),
turns AS (SELECT c.conv_id, 0 AS part, t.pos, role, text FROM c JOIN t ON t.conv_id = c.first_id AND t.pos < c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS pos, strlen(text) AS n_bytes,
  strlen(role)::varchar || ':' || role || strlen(text)::varchar || ':' || text AS turn FROM turns),
s AS (SELECT conv_id, 0 AS depth, '' AS path, NULL AS parent, 0 AS n_bytes FROM c UNION ALL
  SELECT a.conv_id, a.pos, string_agg(b.turn, '' ORDER BY b.pos), coalesce(string_agg(b.turn, '' ORDER BY b.pos) FILTER (b.pos < a.pos), ''), any_value(a.n_bytes)
  FROM placed a JOIN placed b ON a.conv_id = b.conv_id AND b.pos <= a.pos GROUP BY a.conv_id, a.pos),
n AS (SELECT depth, path, any_value(parent) AS parent, any_value(n_bytes) AS n_bytes, min(conv_id) AS conv_id, count(*) AS n_convs FROM s GROUP BY depth, path),
kids AS (SELECT depth - 1 AS depth, parent AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
below AS (SELECT a.depth, a.path, sum((b.n_convs - 1) * b.n_bytes) AS saved, count(*) FILTER (k.n_children IS NULL) AS n_leaves FROM n a JOIN n b ON b.depth >= a.depth AND starts_with(b.path, a.path)
  LEFT JOIN kids k ON k.depth = b.depth AND k.path = b.path GROUP BY a.depth, a.path),
ends AS (SELECT depth, path, string_agg(s.conv_id::varchar, ',' ORDER BY s.conv_id) AS ids FROM s JOIN (SELECT conv_id, max(depth) AS depth FROM s GROUP BY conv_id) w USING (conv_id, depth) GROUP BY depth, path)
SELECT n.conv_id, n.depth::bigint AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::bigint AS n_children, n_leaves::bigint AS n_leaves, saved::bigint AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.path = n.parent LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path
JOIN below b ON b.depth = n.depth AND b.path = n.path LEFT JOIN ends e ON e.depth = n.depth AND e.path = n.path"""
}
