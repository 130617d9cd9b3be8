"""Near-duplicate documents by Order MinHash (operator 9).

Sketch: for each of ``VALUES`` hash functions the ``2`` smallest occurrence-labelled shingles of
``SHINGLE`` words are taken and hashed in their text order, so a value agrees when both the shingles
and their order do. ``TABLES`` tables each combine ``ROWS`` values into a bucket key. Candidates are
verified by banded alignment of the word sequences: similarity is the largest share of shingles that an
alignment of the words pairs up, ``m / (a + b - m)``, and documents at ``THRESHOLD`` or more are linked. A document's class is the
connected component of links; its id is the smallest ``doc_id`` in it.

Scale: equal texts collapse to one representative first, with partial aggregation, so copies never
meet in a bucket. Buckets are worked through in ``BATCHES`` of tables. In each of them a bucket gives
pairs with its leader only, and only for members that lie in another component so far, so a large group
of look-alikes is one component after the first few tables and gives no further pairs. At the end
every bucket that still spans several components compares what lies outside its largest component with
all of its members in other components. No bucket is capped and no pair that could join two components is
skipped; pairs inside a component can't change the result. Every join of a bucket has an exact bound in
its condition: the parities of the shingles by a hash of ``PARITIES`` values differ in at most as many
places as there are shingles of one text only, so that pairs with too many of these needn't be aligned; texts with more
than half as many shingles have parities in proportion to their length besides.
Components are found on the graph of components, by joins over the links, each iteration written to the
shared folder.

Edge cases: a null text, or one without words, is a class of its own; a text with fewer words than a
shingle is one shingle; equal texts are one class at any length; rows that repeat a ``doc_id`` each
give a row, by their own text; a null ``doc_id`` has a null class; an empty table gives an empty
result; further columns are ignored by ``near_duplicate_classes`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

SHINGLE = 5
THRESHOLD = 0.8
VALUES = 128
# All tables draw from the same values; with that, 0.1 % of the pairs that agree in 64 % of them (similarity 0.8) share no bucket
# in a simulation of 40,000. 64 tables of 6 lose 3.4 %, 48 of 5 1.5 %, 64 of 5 0.5 %.
TABLES = 96
ROWS = 5
BATCHES = (0, 2, 12, TABLES)
PARITIES = 1024
HOT_COPIES = 1_000
BROADCAST_IDS = 2_000_000
BROADCAST_SKETCHES = 200_000
PAIRS_A_TASK = 256

_RNG = np.random.default_rng(9)
_FACTOR = (_RNG.integers(1, 1 << 31, VALUES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_MASK = _RNG.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)
_PICKS = np.stack([_RNG.permutation(VALUES)[:ROWS] for _ in range(TABLES)])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: bytes, cache: dict[bytes, int]) -> np.ndarray:
    words = raw.split()
    for w in set(words):
        if w not in cache:
            cache[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def labelled_shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash for each shingle and its occurrence number in the text."""
    size = min(size, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - size + 1 + i])
    order = np.argsort(h, kind="stable")
    first = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    if not first.all():
        run = np.flatnonzero(first)
        occurrence = np.empty(len(h), np.uint64)
        occurrence[order] = (np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))).astype(np.uint64)
        h = np.where(occurrence > 0, _mix(h + occurrence * np.uint64(0xD6E8FEB86659FD93)), h)  # a first one is the same in every text
    return h


def sketch(shingles: np.ndarray) -> np.ndarray:
    """``VALUES`` numbers: each hashes the two smallest shingles of one hash function in text order."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    best1 = np.empty(VALUES, np.int64)
    best2 = np.empty(VALUES, np.int64)
    step = max(1, (1 << 20) // len(low))
    for at in range(0, VALUES, step):
        k = np.arange(at, min(VALUES, at + step))
        values = (low ^ _MASK[k, None]) * _FACTOR[k, None]
        values ^= values >> np.uint32(15)
        rows = np.arange(len(k))
        best1[k] = values.argmin(axis=1)
        values[rows, best1[k]] = np.uint32(0xFFFFFFFF)
        best2[k] = values.argmin(axis=1)
    early, late = shingles[np.minimum(best1, best2)], shingles[np.maximum(best1, best2)]
    return _mix(early * np.uint64(0x9E3779B97F4A7C15) + late).astype(np.uint32)


def parities(shingles: np.ndarray, n: int = PARITIES) -> np.ndarray:
    """Whether an odd number of shingles has each of n values of a hash, as 64-bit numbers.

    Shingles that two texts share cancel out, so two of these differ in at most as many bits as there are others.
    """
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % n, minlength=n) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_parities(shingles: np.ndarray) -> np.ndarray | None:
    """Parities of a long text, twice as many as it has shingles at least, a power of two: few of its shingles meet in one."""
    n = len(shingles)
    return None if 2 * n <= PARITIES else parities(shingles, 1 << (2 * n - 1).bit_length())


BITS = [f"p{i}" for i in range(PARITIES // 64)]
MADE = f"doc_id long, th long, exact binary, n int, {', '.join(f'{p} long' for p in BITS)}, wide array<long>, keys array<long>"


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[bytes, int] = {}
    kinds = (pa.binary(), pa.int32(), *[pa.int64() for _ in BITS], pa.list_(pa.int64()), pa.list_(pa.int64()))
    for batch in batches:
        rows: list[tuple] = []
        for text in batch.column(2).to_pylist():
            raw = (text or "").encode("utf-8", "surrogatepass")
            if len(cache) > 300_000:
                cache.clear()
            words = word_hashes(raw, cache)
            if not len(words):
                rows.append((None,) * len(kinds))
                continue
            shingles = labelled_shingles(words)
            values = sketch(shingles)
            key = np.arange(TABLES, dtype=np.uint64)
            for i in range(ROWS):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + values[_PICKS[:, i]])
            rows.append((hashlib.md5(b" ".join(raw.split())).digest(), len(shingles), *parities(shingles).tolist(), wide_parities(shingles), key.astype(np.int64)))
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], [c.split()[0] for c in MADE.split(", ")])


def most_unpaired(sa: int, sb: int, threshold: float) -> int:
    """Shingles of both texts that may have no partner at this similarity."""
    return int((sa + sb) * (1 - threshold) / (1 + threshold) + 1e-9)


def _greedy_pairs(a: list[int], b: list[int], size: int, most: int) -> int:
    """Shingles paired by a furthest-reaching alignment with the fewest edits: a lower bound of what can be paired."""
    na, nb = len(a), len(b)
    reach = {1: (0, 0)}  # by diagonal: how far a got, shingles paired so far
    for d in range(most + 1):
        new = {}
        for k in range(-d, d + 1, 2):
            down = k == -d or (k != d and reach[k - 1][0] < reach[k + 1][0])
            x, paired = reach[k + 1] if down else reach[k - 1]
            x += not down
            y = x - k
            if x > na or y > nb:
                new[k] = (x, paired)
                continue
            begin = x
            while x < na and y < nb and a[x] == b[y]:
                x += 1
                y += 1
            paired += max(0, x - begin - size + 1)
            if x >= na and y >= nb:
                return paired
            new[k] = (x, paired)
        reach = new
    return 0


def most_pairs(a: np.ndarray, b: np.ndarray, size: int, need: int, most: int) -> int:
    """The most shingles that an alignment of the words can pair, inside the band that ``most`` unpaired ones leave.

    A pair either goes on with the pair before it on its diagonal, or begins behind all words of earlier pairs. 0 if it's below ``need``.
    """
    sa, sb = len(a), len(b)
    low, high = (sb - sa - most) // 2, (sb - sa + most + 1) // 2  # diagonals j - i
    width = high - low + 1
    b = np.concatenate([np.zeros(max(0, -low), b.dtype), b, np.zeros(max(0, high + sa - sb), b.dtype)])  # b[j] is at j - min(low, 0)
    valid = np.zeros(len(b), bool)
    valid[max(0, -low) : max(0, -low) + sb] = True
    begin = max(0, -low)
    ending = np.zeros(width, np.int32)  # pairs of an alignment that ends with this pair, by diagonal
    best = [np.zeros(width, np.int32) for _ in range(size + 1)]  # of the last rows: the most pairs up to this row and diagonal
    for i in range(sa):
        at = begin + i + low
        match = (b[at : at + width] == a[i]) & valid[at : at + width]
        # row i - size, column j - size: the same diagonal
        ending = np.where(match, np.maximum(ending, best[(i - size) % (size + 1)] if i >= size else 0) + 1, 0).astype(np.int32)
        above = np.append(best[(i - 1) % (size + 1)][1:], 0) if i else 0  # the same column is one diagonal up in the row before
        best[i % (size + 1)] = np.maximum.accumulate(np.maximum(ending, above))
        if best[i % (size + 1)][-1] + sa - 1 - i < need:
            return 0
    return int(best[(sa - 1) % (size + 1)].max())


def aligned_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, size: int = SHINGLE) -> float:
    """Share of shingles that a best alignment of the words pairs up; 0 once it must be below the threshold.

    Texts whose shingles in common are too few in any order aren't aligned. A greedy alignment may prove a pair, else the
    exact one is computed inside the band of diagonals that the threshold leaves.
    """
    if np.array_equal(a, b):
        return 1.0
    na, nb = len(a), len(b)
    if min(na, nb) < size:
        return 0.0
    sa, sb = na - size + 1, nb - size + 1
    if min(sa, sb) < threshold * max(sa, sb):
        return 0.0
    most = most_unpaired(sa, sb, threshold)
    need = -(-(sa + sb - most) // 2)
    ha, hb = labelled_shingles(a.astype(np.uint64), size), labelled_shingles(b.astype(np.uint64), size)
    if len(np.intersect1d(ha, hb, assume_unique=True)) < need:
        return 0.0
    paired = _greedy_pairs(a.tolist(), b.tolist(), size, min(most, 64))
    if paired < need:
        _, codes = np.unique(np.concatenate([np.lib.stride_tricks.sliding_window_view(x, size) for x in (a, b)]), axis=0, return_inverse=True)
        paired = most_pairs(codes[:sa] + 1, codes[sa:] + 1, size, need, most)
    similarity = paired / (sa + sb - paired)
    return similarity if similarity >= threshold else 0.0


def _verify_batches(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [aligned_similarity(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), threshold) >= threshold for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["ca", "cb"]).filter(pa.array(good, pa.bool_()))

    return verify


def _words_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[bytes, int] = {}
    for batch in batches:
        if len(cache) > 300_000:
            cache.clear()
        words = [word_hashes((t or "").encode("utf-8", "surrogatepass"), cache).astype("<u4").tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(words, pa.binary())], ["doc_id", "th", "words"])


NODE = "struct<doc_id:bigint,th:bigint>"  # a text: its smallest doc_id and the hash of that row's text


def few(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Rows for a join: broadcast up to a checked count (``BROADCAST_IDS`` of a few columns), else shuffled."""
    return F.broadcast(rows) if rows.count() <= (BROADCAST_IDS if most is None else most) else rows


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")


def may_reach(x: str, y: str, threshold: float) -> Column:
    """False only for pairs below the threshold: of ``a + b`` shingles at most this share may be unpaired at it."""
    na, nb = F.col(f"{x}.n"), F.col(f"{y}.n")
    most = F.floor((na + nb) * ((1 - threshold) / (1 + threshold)) + 1e-9)
    differ = sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in BITS), F.lit(0))
    wa, wb = F.col(f"{x}.wide"), F.col(f"{y}.wide")
    xor = lambda p, q: p.bitwiseXOR(q)
    half = lambda w: F.zip_with(F.slice(w, 1, F.shiftright(F.size(w), 1)), F.slice(w, F.shiftright(F.size(w), 1) + 1, F.shiftright(F.size(w), 1)), xor)
    folded = lambda w, other: F.when(F.size(w) > F.size(other), half(w)).otherwise(w)
    apart = F.aggregate(F.zip_with(folded(wa, wb), folded(wb, wa), xor), F.lit(0), lambda n, z: n + F.bit_count(z))
    near = (F.least(na, nb) >= F.greatest(na, nb) * threshold) & (differ <= most)
    return F.when(near, wa.isNull() | wb.isNull() | (apart <= most)).otherwise(False)


FIELDS = ["rep", "component", "n", *BITS, "wide"]


def leader_pairs(entries: DataFrame, threshold: float) -> DataFrame:
    """Of each bucket that spans several components, its least member with all that lie in others and may be similar."""
    lead = entries.groupBy("key").agg(F.min(F.struct(*FIELDS)).alias("x"), F.min("component").alias("low"), F.max("component").alias("high"))
    lead = lead.filter("low < high").select(F.col("key").alias("own_key"), "x")
    met = entries.select("key", F.struct(*FIELDS).alias("y"))
    apart = F.col("x.component") != F.col("y.component")
    return _pairs(met.join(lead, (F.col("key") == F.col("own_key")) & apart & may_reach("x", "y", threshold)))


def all_pairs(entries: DataFrame, threshold: float) -> DataFrame:
    """Of each bucket, what lies outside its largest component with all members of other components that may be similar."""
    sizes = entries.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key")
    main = sizes.agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("m")).filter("m > 1").select("key", F.col("main.component").alias("main"))
    placed = entries.join(main, "key").select("key", F.struct(*FIELDS).alias("x"), "main")
    rest = placed.filter("x.component <> main").select(F.col("key").alias("own_key"), F.col("x").alias("y"))
    once = (F.col("x.component") == F.col("main")) | (F.col("x.rep") < F.col("y.rep"))
    apart = F.col("x.component") != F.col("y.component")
    return _pairs(placed.join(rest, (F.col("key") == F.col("own_key")) & once & apart & may_reach("x", "y", threshold)))


def _pairs(met: DataFrame) -> DataFrame:
    a, b = F.least("x.rep", "y.rep"), F.greatest("x.rep", "y.rep")
    return met.groupBy(a.alias("a"), b.alias("b")).agg(F.first("x.component").alias("ca"), F.first("y.component").alias("cb"))


def verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """Links (ca, cb) between the components of pairs whose whole word sequences are similar by banded alignment."""
    left = words.select(F.col("rep").alias("a"), F.col("words").alias("words_a"))
    right = words.select(F.col("rep").alias("b"), F.col("words").alias("words_b"))
    both = pairs.join(right, "b").join(left, "a")
    both = both.repartition(pairs.count() // PAIRS_A_TASK + 1, "a", "b")  # much work for few bytes
    return both.select("ca", "cb", "words_a", "words_b").mapInArrow(_verify_batches(threshold), f"ca {NODE}, cb {NODE}")


def components(links: DataFrame) -> DataFrame:
    """(node, low) for every node of the links; low is the smallest node that it is connected to."""
    ends = links.toDF("a", "b")
    edges = written(ends.union(ends.select("b", "a")).distinct(), "near-edges")
    label = written(edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")).withColumnRenamed("a", "node"), "near-label")
    while True:
        around = edges.join(few(label), edges["b"] == label["node"]).groupBy("a").agg(F.min("low").alias("other"))
        lower = label.join(around, label["node"] == around["a"]).select("node", F.col("low").alias("old"), F.least("low", "other").alias("new"))
        above = label.select(F.col("node").alias("new"), F.col("low").alias("above"))
        stepped = lower.join(few(above), "new", "left").select("node", "old", F.least("new", F.coalesce("above", "new")).alias("low"))
        stepped = written(stepped, "near-label")
        if stepped.filter("low <> old").isEmpty():
            return stepped.select("node", "low")
        label = stepped.select("node", "low")


def _linked(label: DataFrame, pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """The labels after the pairs that prove similar have joined their components."""
    links = written(verified(pairs, words, threshold).distinct(), "near-links")
    if links.isEmpty():
        return label
    joined = components(links).select(F.col("node").alias("component"), "low")
    return written(label.join(few(joined), "component", "left").withColumn("component", F.coalesce("low", "component")).drop("low"), "near-label")


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, ``th`` (hash of its text), ``rep`` (smallest doc_id with an equal text) and ``class_id``."""
    docs = keyed(docs)
    made = written(docs.mapInArrow(_sketch_batches, MADE), "near-sketches")
    # all of it follows from the text, so whichever copy gives them gives the same
    firsts = [F.first(c).alias(c) for c in ("n", *BITS, "wide", "keys")]
    texts = made.filter("exact IS NOT NULL AND doc_id IS NOT NULL").groupBy("exact")
    texts = written(texts.agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.count("*").alias("copies"), *firsts), "near-texts")
    entries = texts.select("rep", F.posexplode("keys").alias("table", "key"))
    shared = written(entries.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "near-shared")
    buckets = written(entries.join(few(shared), "key"), "near-buckets")  # all that share a bucket with another text
    members = written(buckets.select("rep").distinct(), "near-members")
    own = docs.join(few(members.select("rep.*")), ["doc_id", "th"], "left_semi").mapInArrow(_words_batches, "doc_id long, th long, words binary")
    words = own.groupBy(F.struct("doc_id", "th").alias("rep")).agg(F.first("words").alias("words"))  # a row may be there twice
    words = written(words, "near-words", compression="none")
    label = written(texts.join(few(members), "rep").select("rep", F.col("rep").alias("component"), "n", *BITS, "wide"), "near-label")
    for begin, end in zip(BATCHES[:-1], BATCHES[1:], strict=True):
        placed = buckets.filter(F.col("table").between(begin, end - 1)).join(few(label, min(BROADCAST_IDS, BROADCAST_SKETCHES)), "rep")
        label = _linked(label, written(leader_pairs(placed, threshold), "near-pairs"), words, threshold)
    label = _linked(label, written(all_pairs(buckets.join(few(label, min(BROADCAST_IDS, BROADCAST_SKETCHES)), "rep"), threshold), "near-pairs"), words, threshold)
    classes = texts.select("exact", "copies", "rep").join(few(label.select("rep", "component")), "rep", "left")
    classes = classes.select("exact", "copies", F.col("rep.doc_id").alias("rep"), F.coalesce("component", "rep").getField("doc_id").alias("class_id"))
    return _placed(made.select("doc_id", "th", "exact"), written(classes, "near-classes"))


def _placed(made: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes by row. Texts with very many copies are broadcast, at most ``HOT_COPIES`` of them, as they hold a share of all rows."""
    least = (made.count() // HOT_COPIES) + 1
    classes = classes.withColumnRenamed("exact", "e")
    hot = F.broadcast(classes.filter(F.col("copies") >= least))
    rest = made.join(hot.select("e"), F.col("exact") == F.col("e"), "left_anti")
    both = rest.join(classes.filter(F.col("copies") < least), F.col("exact") == F.col("e"), "left").unionByName(made.join(hot, F.col("exact") == F.col("e")))
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return both.select("doc_id", "th", F.coalesce("rep", "doc_id").alias("rep"), class_id.alias("class_id"))


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, that with the smallest ``doc_id``, with all columns.

    Rows with a null ``doc_id`` have no class and stay; rows that repeat a ``doc_id`` go by their own text.
    """
    gone = near_duplicate_classes(docs, threshold).filter("doc_id <> class_id")
    gone = written(gone.select(F.col("doc_id").alias("__gone_id"), F.col("th").alias("__gone_text")).distinct(), "near-gone")
    here = (docs["doc_id"].cast("long") == F.col("__gone_id")) & (F.xxhash64(docs["text"]) == F.col("__gone_text"))
    return docs.join(few(gone), here, "left_anti")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "rep")


QUERIES = {"op9_order_minhash": op9_order_minhash}
ORACLE_SQL: dict[str, str] = {}
