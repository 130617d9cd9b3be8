"""Benchmark decontamination by edit similarity (operator 5).

A document is contaminated when a benchmark item of ``m`` words lies in it within ``(1 - SIMILARITY) * m``
word edits (insertions, deletions, replacements). Words are lower-cased runs of letters and digits.

1. Count filter (loses nothing): an item within k edits keeps at least ``m - q + 1 - k * q`` of its
   q-word grams, so only window starts around which so many grams occur go on. Items are dealt to 64
   groups, a few for each length class, and a table of a bounded size has for each hashed gram the
   groups that hold it. Grams are counted by group, as all those of one item are in one group.
2. CGK embedding: a random walk over the words of an item-sized window, which copies the word it
   stands on and steps or stays by a hashed coin, turns edit distance into Hamming distance.
3. Bit sampling: ``repeats`` walks, ``samples`` sampled positions each, make the bucket keys that
   windows and items of a group are joined on. Items are sorted into classes of similar length, whose shortest
   item sets the length of the walk. Both numbers go by the class, so that an item with exactly the
   allowed edits is found with ``TARGET_RECALL`` at any length, whatever the kind of its edits.
4. Exact verification: the least edit distance between the item and any prefix of the window.

Items with equal words are searched once. Their keys are an ordinary table (broadcast up to
``BROADCAST_KEYS`` rows, shuffled beyond), so the benchmark may be large too. Edge cases: null or
empty texts and items match nothing; an item of one to four words allows no edit and is found
exactly; items with equal texts all match; a null ``item_id`` is reported as such; rows that repeat a
``doc_id`` are searched as one document each and reported once; a document with a null ``doc_id`` is
not reported by ``contaminated``, but ``decontaminate`` judges it by its text like all others; empty
tables give an empty result; further columns are ignored by ``contaminated`` and kept by
``decontaminate``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

SIMILARITY = 0.8
CLASS_FROM = 5
GRAM = 3
GROUPS = 64
TARGET_RECALL = 0.99
TWO_SAMPLES_TO = 25
CLASS_GROWTH = 1.25
WORD = re.compile(r"[^\W_]+")
LEAST_BITS, MOST_BITS = 16, 23
BROADCAST_KEYS = 1_000_000
BLOCK = 1 << 20
FOUND = "__contaminated_text"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str | None, cache: dict[str, int]) -> np.ndarray:
    """Hashes of the words, never 0."""
    words = WORD.findall(text.lower()) if text else []
    for w in set(words):
        if w not in cache:
            cache[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) | 1
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, q: int) -> np.ndarray:
    if len(words) < q:
        return np.zeros(0, np.uint64)
    h = np.full(len(words) - q + 1, q, np.uint64)
    for i in range(q):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - q + 1 + i])
    return h


def edits(m: int, similarity: float = SIMILARITY) -> int:
    return math.floor((1 - similarity) * m + 1e-9)


def class_of(m: int) -> int:
    """Number of the length class; below ``CLASS_FROM`` words, where no edit is allowed, each length is one."""
    return math.floor(math.log(m / CLASS_FROM) / math.log(CLASS_GROWTH) + 1e-9)


class LengthClass:
    """Lengths from ``low`` to ``high`` words: gram size, least gram count, window and walk lengths."""

    def __init__(self, number: int, similarity: float):
        lengths = [m for m in range(1, math.ceil(CLASS_FROM * CLASS_GROWTH ** (number + 1)) + 2) if class_of(m) == number]
        self.number, self.low, self.high = number, min(lengths, default=0), max(lengths, default=0)
        if not lengths:
            return
        counts = {q: min(m - q + 1 - edits(m, similarity) * q for m in lengths) for q in range(GRAM, 0, -1)}
        self.gram = next((q for q, n in counts.items() if n >= 2), 1)
        self.count = max(1, counts[self.gram])
        self.slack = edits(self.high, similarity)
        self.window = self.high + self.slack
        self.steps = max(2, int(1.8 * self.low))
        # Measured for TARGET_RECALL at exactly the allowed edits, deletions alone being the hardest: two samples need up to 25
        # walks at 23 words, but 127 at 72 and beyond 5,000 at 222; one sample needs 20 at 46, 33 at 72, 85 at 222, 191 at 433.
        if not self.slack:
            self.samples, self.repeats = 2, 1  # equal windows have equal walks
            return
        self.samples, self.repeats = (2, 28) if self.high <= TWO_SAMPLES_TO else (1, max(24, math.ceil(self.high / 2)))


@lru_cache(maxsize=256)
def _walks(number: int, steps: int, repeats: int, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Coins and sampled positions of the walks of one length class: steps x repeats each."""
    coins, picked = np.empty((steps, repeats), np.uint64), np.zeros((steps, repeats), bool)
    for r in range(repeats):
        rng = np.random.default_rng([5, number & 0xFFFF, r])
        picked[rng.permutation(steps)[:samples], r] = True
        coins[:, r] = rng.integers(0, 1 << 63, steps, dtype=np.uint64)
    return coins, picked


def cgk_keys(windows: np.ndarray, cls: LengthClass, group: int = 0) -> np.ndarray:
    """rows x ``cls.repeats`` keys of padded word windows (0 behind the end) within a group, all walks at once."""
    coins, picked = _walks(cls.number, cls.steps, cls.repeats, cls.samples)
    rows, last = np.arange(len(windows))[:, None], windows.shape[1] - 1
    at = np.zeros((len(windows), cls.repeats), np.int64)
    key = np.broadcast_to(np.arange(cls.repeats, dtype=np.uint64) + np.uint64((cls.number & 0xFFFF) << 32 | group << 48), at.shape).copy()
    for t in range(int(np.flatnonzero(picked.any(axis=1)).max()) + 1):
        here = windows[rows, at]
        own = np.flatnonzero(picked[t])
        if len(own):
            key[:, own] = _mix(key[:, own] * np.uint64(0x9E3779B97F4A7C15) + here[:, own])
        at += (((here ^ coins[t]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, last, out=at)
    return key


def _pad(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    padded = np.concatenate([words, np.zeros(length, np.uint64)])
    return padded[starts[:, None] + np.arange(length)]


def edit_distance(item: np.ndarray, window: np.ndarray, most: int) -> int:
    """Least word edit distance between the item and a prefix of the window; ``most`` + 1 if above ``most``."""
    n = len(window)
    row = np.arange(n + 1)
    steps = np.arange(n + 1)
    for i, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (window != w), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps  # insertions run along the row
        if row.min() > most:
            return most + 1
    return min(int(row.min()), most + 1)


def edit_distances(items: np.ndarray, windows: np.ndarray, most: int) -> np.ndarray:
    """``edit_distance`` of each row of items with that of windows (0 behind the end, which equals no word)."""
    out = np.full(len(items), most + 1, np.int32)
    left, steps = np.arange(len(items)), np.arange(windows.shape[1] + 1, dtype=np.int32)
    row = np.broadcast_to(steps, (len(items), len(steps)))
    for i in range(1, items.shape[1] + 1):
        new = np.empty(row.shape, np.int32)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, :-1] + (windows != items[:, i - 1 : i]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        if i % 4 == 0:
            near = row.min(axis=1) <= most
            if not near.all():
                left, row, items, windows = left[near], row[near], items[near], windows[near]
    out[left] = np.minimum(row.min(axis=1), most + 1)
    return out


def _class_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = (len(WORD.findall((t or "").lower())) for t in batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array({class_of(n) for n in lengths if n}, pa.int32())], ["cls"])


def groups_of(place: int, n_classes: int) -> list[int]:
    """The groups of the length class at this place of all: its own ones, as long as there are no more than ``GROUPS`` classes."""
    own = max(1, GROUPS // n_classes)
    return [(place * own + i) % GROUPS for i in range(own)]


def _item_batches(similarity: float, numbers: list[int]):
    """item (hash of its words), item_id, class, group, words, keys and grams."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        classes = {n: (LengthClass(n, similarity), groups_of(i, len(numbers))) for i, n in enumerate(numbers)}
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = word_hashes(text, cache)
                if not len(words):
                    continue
                cls, groups = classes[class_of(len(words))]
                item = xxhash.xxh64_intdigest(words.tobytes())
                group = groups[item % len(groups)]
                keys = cgk_keys(_pad(words, np.zeros(1, np.int64), cls.window), cls, group)[0]
                grams = np.unique(gram_hashes(words, cls.gram))
                rows.append((item - (item >> 63 << 64), item_id, cls.number, group, words.tobytes(), keys.astype(np.int64), grams.astype(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = ["item", "item_id", "cls", "grp", "item_words", "keys", "grams"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return made


def hashed_table(marks: DataFrame) -> np.ndarray:
    """By the leading bits of the hash ``h`` all bits of ``mark`` together: of a bounded size, no false negatives."""
    n = marks.agg(F.approx_count_distinct("h")).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(64 * max(1, n)))))
    rows = marks.groupBy(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("place")).agg(F.bit_or("mark").alias("mark"))
    packed = np.zeros(1 << bits, np.uint64)
    for frame in rows.toArrow().to_batches():  # at most 2**MOST_BITS rows
        packed[frame.column(0).to_numpy()] = frame.column(1).to_numpy().view(np.uint64)
    return packed


def _look_up(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    return packed[(h >> np.uint64(65 - len(packed).bit_length())).astype(np.int64)]


def candidate_starts(places: np.ndarray, n_words: int, cls: LengthClass) -> np.ndarray:
    """Window starts with enough grams in the window; ``places`` has the sorted starts of one group's grams."""
    first, last = places[: len(places) - cls.count + 1], places[cls.count - 1 :]
    low, high = np.maximum(0, last - (cls.window - cls.gram)), first
    edge = np.zeros(n_words + 1, np.int32)
    good = low <= high
    np.add.at(edge, low[good], 1)
    np.add.at(edge, high[good] + 1, -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def _blocks(batches: Iterator[pa.RecordBatch], cache: dict[str, int]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Row ids, all their words and where each row's words begin, about ``BLOCK`` words at a time."""
    ids, parts, size = [], [], 0
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = word_hashes(text, cache)
            ids.append(row), parts.append(words)
            size += len(words)
            if size >= BLOCK:
                yield ids, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
                ids, parts, size = [], [], 0
                if len(cache) > 300_000:
                    cache.clear()
    if size:
        yield ids, np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def _candidates(classes: list[LengthClass], grams: np.ndarray, words: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, LengthClass, int, np.ndarray]]:
    """(row, class, group, window starts) that pass the count filter."""
    for q in sorted({c.gram for c in classes}):
        own = [(c, g) for i, c in enumerate(classes) if c.gram == q for g in groups_of(i, len(classes))]
        found = _look_up(grams, gram_hashes(words, q))
        at = np.flatnonzero(found)
        row = np.searchsorted(begin, at, side="right") - 1
        inside = at + q <= begin[row + 1]  # not across two texts
        at, row = at[inside], row[inside]
        cut = np.flatnonzero(np.diff(row, prepend=-1, append=len(begin)))
        least = min(c.count for c, _ in own)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a < least:
                continue
            places, marks = at[a:b] - begin[row[a]], found[at[a:b]]
            flags = np.unpackbits(marks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            totals = flags.sum(axis=0, dtype=np.int64)
            for cls, group in own:
                if totals[group] >= cls.count:
                    starts = candidate_starts(places[flags[:, group] > 0], int(begin[row[a] + 1] - begin[row[a]]), cls)
                    if len(starts):
                        yield int(row[a]), cls, group, starts


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, first word and edit distance of the best place."""
    docs = docs.select(F.col("doc_id").cast("long").alias("row"), "text").filter("row IS NOT NULL AND text IS NOT NULL")
    return found_items(docs, benchmark, similarity).withColumnRenamed("row", "doc_id")


def found_items(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """row, item_id, first_word and distance, of texts with a ``row`` id."""
    spark = docs.sparkSession
    benchmark = benchmark.select(F.col("item_id").cast("long"), "text")
    numbers = sorted(r["cls"] for r in benchmark.select("text").mapInArrow(_class_numbers, "cls int").distinct().collect())  # a few dozen length classes
    listed = written(
        benchmark.mapInArrow(
            _item_batches(similarity, numbers), "item long, item_id long, cls int, grp int, item_words binary, keys array<long>, grams array<long>"
        ),
        "items",
    )
    items = listed.dropDuplicates(["item"])
    item_keys = written(items.select("item", F.explode("keys").alias("key")), "item-keys")
    marks = items.select(F.explode("grams").alias("h"), F.expr("shiftleft(1L, grp)").alias("mark"))
    shared = spark.sparkContext.broadcast((hashed_table(marks), hashed_table(item_keys.select(F.col("key").alias("h"), F.lit(1).cast("long").alias("mark")))))
    classes = [LengthClass(n, similarity) for n in numbers]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, keys = shared.value
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()))

        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            return pa.RecordBatch.from_arrays(columns, ["row", "start", "cls", "words", "keys"])

        for ids, words, begin in _blocks(batches, {}):
            rows: list[tuple] = []
            for i, cls, group, starts in _candidates(classes, grams, words, begin):
                own = words[begin[i] : begin[i + 1]]
                step = max(64, 100_000 // cls.repeats)
                for some in (starts[at : at + step] for at in range(0, len(starts), step)):
                    padded = _pad(own, some, cls.window)
                    made_keys = cgk_keys(padded, cls, group)
                    hit = _look_up(keys, made_keys) > 0
                    for k in np.flatnonzero(hit.any(axis=1)):
                        rows.append((ids[i], int(some[k]), cls.number, padded[k].tobytes(), made_keys[k][hit[k]].astype(np.int64)))
                if len(rows) > 2000:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    found = written(docs.select("row", "text").mapInArrow(windows, "row long, start int, cls int, words binary, keys array<long>"), "windows")
    few = item_keys.count() <= BROADCAST_KEYS
    pairs = found.select("row", "start", "cls", F.explode("keys").alias("key")).join(F.broadcast(item_keys) if few else item_keys, "key")
    pairs = pairs.select("row", "start", "cls", "item").distinct()
    words_of = items.select("item", "item_words")
    named = pairs.join(found.drop("keys"), ["row", "start", "cls"]).join(F.broadcast(words_of) if few else words_of, "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, places = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            alike: dict[tuple[int, int], list[int]] = {}
            for i, (item, window) in enumerate(zip(items, places, strict=True)):
                alike.setdefault((len(item), len(window)), []).append(i)
            far: list[int | None] = [None] * len(items)
            for (m, n), rows in alike.items():
                m, most = m // 8, edits(m // 8, similarity)
                step = max(1, 200_000 // (n // 8))
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    x = np.frombuffer(b"".join(items[i] for i in some), np.uint64).reshape(len(some), -1)
                    y = np.frombuffer(b"".join(places[i] for i in some), np.uint64).reshape(len(some), -1)[:, : m + most]
                    for i, d in zip(some, edit_distances(x, y, most).tolist(), strict=True):
                        far[i] = d if d <= most else None
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(far, pa.int32())], ["row", "item", "start", "distance"])
            yield out.filter(out.column(3).is_valid())

    checked = named.select("row", "item", "start", "item_words", "words").mapInArrow(verify, "row long, item long, start int, distance int")
    best = checked.groupBy("row", "item").agg(F.min(F.struct("distance", "start")).alias("best"))
    members = listed.select("item", "item_id").distinct()
    best = best.join(F.broadcast(members) if few else members, "item")
    best = best.groupBy("row", "item_id").agg(F.min("best").alias("best"))  # an item_id may stand for several texts
    return best.select("row", "item_id", F.col("best.start").alias("first_word"), F.col("best.distance").alias("distance"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents whose text holds no benchmark item, with all their columns; a null text stays."""
    texts = docs.filter("text IS NOT NULL").select(F.xxhash64("text").alias("row"), "text")
    found = written(found_items(texts, benchmark, similarity).select(F.col("row").alias(FOUND)).distinct(), "contaminated")
    return docs.join(found, F.xxhash64("text") == F.col(FOUND), "left_anti")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontamination": op5_decontamination}
ORACLE_SQL: dict[str, str] = {}
