"""Hard negatives by segment summaries (operator 13).

Vectors are kept in blocks, each with the mean and the deviation of the segments of every vector, at several
segment lengths. For two segments of length n the product lies within ``n (mean mean' +- deviation deviation')``,
so their sums bound a score from both sides. Scans try the coarsest segments first and refine only pairs that the
bounds leave, each level with half as long segments or less; what is left is scored exactly, in integers.

Queries ("anchors") are dealt out in blocks of ``COMPONENTS``, one broadcast for each round. A task reads its blocks of
vectors one after the other and keeps the best so far of each anchor, which raises the bound to beat and is all that it
returns; the best of all tasks are taken by a window of at most that many rows for each task. The first scan finds positives, the
second one the different-label rows between two shares of each positive's score.

Edge cases: rows with a null id, label or vector, or a null or non-finite component take no part; vectors of different
lengths are compared as if the shorter one ended in zeros; an anchor is no row of its own, nor are other rows with its id;
further rows with equal ids count each; further columns are ignored; an empty table, or one without anchors, gives an empty
result. Components are integers of at most 31 bits (``floor(scale * x)``, clipped); with large ones bounds are left out, as
they need exact doubles, and scores are those of 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
COMPONENTS = 1 << 18  # of a block: 4,096 vectors of 64, 3 MB with their summaries
PAIRS_AT_ONCE = 1 << 20
LEVELS = (16, 4, 2)  # segment lengths, coarsest first
DENSE = 0.05  # of the pairs of a block; beyond it scores come from one matrix product
EXACT = 2.0**45  # bounds of larger scores could be wrong by rounding
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

KINDS = (pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.binary()))
FIELDS = ["vec_ids", "labels", "width", "vectors", "summaries"]
BLOCK = ", ".join(f"{n} {k}" for n, k in zip(FIELDS, ("binary", "binary", "int", "binary", "array<binary>"), strict=True))


def summaries(vectors: np.ndarray, length: int) -> np.ndarray:
    """Means and deviations of the segments of each vector, times the root of their lengths: their products are bounds of scores."""
    width = -(-vectors.shape[1] // length) * length
    parts = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1]))).reshape(len(vectors), -1, length).astype(np.float64)
    root = np.sqrt(length)
    return np.stack([parts.mean(axis=2) * root, parts.std(axis=2) * root]).astype(np.float32)


def _pack_block(ids: list[int], labels: list[int], vectors: list[np.ndarray]) -> pa.RecordBatch:
    width = max(map(len, vectors))
    block = np.zeros((len(vectors), width), np.int32)
    for i, v in enumerate(vectors):
        block[i, : len(v)] = v
    sums = [summaries(block, n).tobytes() for n in LEVELS]
    row = (np.array(ids, np.int64).tobytes(), np.array(labels, np.int64).tobytes(), width, block.tobytes(), sums)
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, KINDS, strict=True)], FIELDS)


def _pack_blocks(scale: int, components: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, width = [], [], [], 1
        for batch in batches:
            lists = batch.column(2)
            flat, offsets = np.asarray(lists.flatten()).astype(np.float64), np.asarray(lists.offsets)
            whole = np.clip(np.floor(scale * flat), -(2.0**31) + 1, 2.0**31 - 1).astype(np.int32)
            offsets = offsets - offsets[0]
            for i, (vec_id, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                ids.append(vec_id)
                labels.append(label)
                vectors.append(whole[offsets[i] : offsets[i + 1]])
                width = max(width, len(vectors[-1]))
                if (len(ids) + 1) * width > components:
                    yield _pack_block(ids, labels, vectors)
                    ids, labels, vectors, width = [], [], [], 1
        if ids:
            yield _pack_block(ids, labels, vectors)

    return pack


class Block:
    """Vectors with their ids, labels and summaries by level."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, levels: list[np.ndarray]):
        self.ids, self.labels, self.vectors, self.levels = ids, labels, vectors, levels
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0))

    @staticmethod
    def read(row: dict, prefix: str = "") -> Block:
        ids, labels = (np.frombuffer(row[prefix + c], np.int64) for c in ("vec_ids", "labels"))
        vectors = np.frombuffer(row[f"{prefix}vectors"], np.int32).reshape(len(ids), row[f"{prefix}width"])
        levels = [np.frombuffer(x, np.float32).reshape(2, len(ids), -1).astype(np.float64) for x in row[f"{prefix}summaries"]]
        return Block(ids, labels, vectors, levels)

    def pieces(self, rows: int) -> Iterator[Block]:
        for at in range(0, len(self.ids), rows):
            end = at + rows
            yield Block(self.ids[at:end], self.labels[at:end], self.vectors[at:end], [x[:, at:end] for x in self.levels])


def between(rows: Block, anchors: Block, low: np.ndarray, high: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of the allowed pairs with a score from ``low`` to ``high`` of the anchor."""
    most = rows.norm * anchors.norm
    certain, margin = most < EXACT, 0.5 + 1e-6 * most  # summaries are rounded to 24 bits
    i, j = None, None  # pairs left, once they are few
    for level, (x, y) in enumerate(zip(rows.levels, anchors.levels, strict=True)):
        if not certain:
            break
        n = min(x.shape[2], y.shape[2])  # what only one of them has meets zeros
        x, y = x[:, :, :n], y[:, :, :n]
        if i is None:
            middle, reach = x[0] @ y[0].T, x[1] @ y[1].T + margin
            allowed = allowed & (middle + reach >= low) & (middle - reach <= high)
            if allowed.mean() < DENSE or level == len(LEVELS) - 1 and allowed.mean() < 4 * DENSE:
                i, j = np.nonzero(allowed)
        elif len(i):
            middle, reach = np.einsum("ij,ij->i", x[0][i], y[0][j]), np.einsum("ij,ij->i", x[1][i], y[1][j]) + margin
            good = (middle + reach >= low[j]) & (middle - reach <= high[j])
            i, j = i[good], j[good]
    n = min(rows.vectors.shape[1], anchors.vectors.shape[1])
    if i is None and certain:
        scores = rows.vectors[:, :n].astype(np.float64) @ anchors.vectors[:, :n].astype(np.float64).T
        i, j = np.nonzero(allowed & (scores >= low) & (scores <= high))
        return i, j, scores[i, j].astype(np.int64)
    if i is None:
        i, j = np.nonzero(allowed)
    scores = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        scores[at : at + (1 << 16)] = np.einsum("ij,ij->i", rows.vectors[a, :n].astype(np.int64), anchors.vectors[b, :n].astype(np.int64))
    good = (scores >= low[j]) & (scores <= high[j])
    return i[good], j[good], scores[good]


class Best:
    """The best ``size`` pairs of every query so far, by score and then smaller id."""

    def __init__(self, size: int, n: int):
        self.size, self.floor = size, np.full(n, LEAST)
        self.query, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        begin = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        full = rank == self.size - 1
        self.floor[query[full]] = score[full]  # an equal score may still have a smaller id
        kept = rank < self.size
        self.query, self.score, self.ids = query[kept], score[kept], ids[kept]


FOUND = "query int, score long, vec_id long"


def _found(best: Best) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(best.query.astype(np.int32)), pa.array(best.score), pa.array(best.ids)], ["query", "score", "vec_id"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block, Block]]:
    """Every block of vectors in pieces, with the anchors of the round."""
    anchors = None
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            anchors = anchors or Block.read(row, "anchor_")  # the same in all rows
            for piece in Block.read(row).pieces(max(1, PAIRS_AT_ONCE // len(anchors.ids))):
                yield row, piece, anchors


def _scan_positives(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for _, rows, anchors in _met(batches):
            best = best or Best(size, len(anchors.ids))
            allowed = (rows.labels[:, None] == anchors.labels) & (rows.ids[:, None] != anchors.ids)
            i, j, score = between(rows, anchors, best.floor, np.full(len(anchors.ids), MOST), allowed)
            best.add(j, score, rows.ids[i])
        if best:
            yield _found(best)

    return scan


def _scan_negatives(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for row, rows, anchors in _met(batches):
            if best is None:
                owner, low, high = (np.frombuffer(row[c], np.int64) for c in ("owner", "low", "high"))  # a query is a positive of an anchor
                best, n = Best(size, len(owner)), len(anchors.ids)
                lowest, highest = np.full(n, MOST), np.full(n, LEAST)
                np.maximum.at(highest, owner, high)
                by_owner = np.argsort(owner, kind="stable")
                begin, end = np.searchsorted(owner[by_owner], np.arange(n)), np.searchsorted(owner[by_owner], np.arange(n), side="right")
            lowest[:] = MOST
            np.minimum.at(lowest, owner, np.maximum(low, best.floor))
            allowed = rows.labels[:, None] != anchors.labels
            i, j, score = between(rows, anchors, lowest, highest, allowed)
            for k in range(int((end - begin).max(initial=0))):  # the k-th positive of every anchor
                some = begin[j] + k < end[j]
                query = by_owner[np.where(some, begin[j] + k, 0)]
                good = some & (score >= np.maximum(low[query], best.floor[query])) & (score <= high[query])
                best.add(query[good], score[good], rows.ids[i[good]])
        if best:
            yield _found(best)

    return scan


def clean_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part."""
    x = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    kept = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    vectors = kept.select(F.col("vec_id").cast("long"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return vectors.filter(~F.exists("embedding", x))


def _ranked(found: DataFrame, size: int) -> DataFrame:
    """The best of each query over all tasks; every task returns at most ``size`` of it."""
    window = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= size)


def hard_negatives(rows: DataFrame, anchor: Column, low: int = 30, high: int = 90, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE) -> DataFrame:
    """For every anchor and each of its best same-label rows, the best different-label rows with ``low`` to ``high`` per cent of that score."""
    vectors = clean_vectors(rows)
    blocks = written(vectors.mapInArrow(_pack_blocks(scale, COMPONENTS), BLOCK), "negatives-blocks")
    chosen = vectors.filter(anchor)
    chosen = written(chosen.repartition(chosen.count() // 4096 + 1).mapInArrow(_pack_blocks(scale, COMPONENTS), BLOCK), "negatives-anchors")
    renamed = chosen.select(F.monotonically_increasing_id().alias("round"), *[F.col(c).alias(f"anchor_{c}") for c in FIELDS])
    renamed, out = written(renamed, "negatives-rounds"), None
    for (round_id,) in renamed.select("round").collect():  # one number for each block of anchors
        own = renamed.filter(F.col("round") == round_id).drop("round")
        best = blocks.crossJoin(F.broadcast(own)).mapInArrow(_scan_positives(positives), FOUND)
        best = written(_ranked(best, positives), "negatives-positives")
        limits = own.join(F.broadcast(_limits(best, low, high)))
        found = blocks.crossJoin(F.broadcast(limits)).mapInArrow(_scan_negatives(negatives), FOUND)
        named = limits.mapInArrow(_name_queries, "query int, anchor_id long, positive_id long, positive_score long")
        made = _ranked(found, negatives).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(F.broadcast(named), "query")
        made = written(made.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives-found")
        out = made if out is None else out.unionByName(made)
    if out is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def _limits(best: DataFrame, low: int, high: int) -> DataFrame:
    """One row: the positives of a round and the scores that their negatives may have."""
    fields = ["query", "rank", "vec_id", "score"]
    return best.groupBy().agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("best")).mapInArrow(_pack_limits(low, high), "owner binary, positive binary, positive_score binary, low binary, high binary")


def _pack_limits(low: int, high: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for best in batch.column(0).to_pylist():
                owner, positive, score = (np.array([b[f] for b in best], np.int64) for f in ("query", "vec_id", "score"))
                least, most = -(-low * score // 100), high * score // 100
                columns = [pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (owner, positive, score, least, most)]
                yield pa.RecordBatch.from_arrays(columns, ["owner", "positive", "positive_score", "low", "high"])

    return pack


def _name_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            owner, positive, score = (np.frombuffer(row[c], np.int64) for c in ("owner", "positive", "positive_score"))
            columns = [pa.array(np.arange(len(owner), dtype=np.int32)), pa.array(np.frombuffer(row["anchor_vec_ids"], np.int64)[owner]), pa.array(positive), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["query", "anchor_id", "positive_id", "positive_score"])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
ORACLE_SQL = {
    "op13_hard_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::double)) AS e FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.e, b.e)::bigint AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::int AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 10"""
}
