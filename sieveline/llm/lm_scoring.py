"""Language-model scores by a weighted backoff automaton (operator 12).

The states of the automaton are the n-grams of up to ``order - 1`` tokens of the training documents. A
seen n-gram is an arc from its first tokens to its last ones with the weight of its smoothed probability;
every state has a failure arc to its shorter suffix with the backoff weight. One traversal of a text from
left to right carries the state and sums weights. Probabilities are smoothed with the mass ``MASS`` of the
shorter context: ``p(w|u) = (c(uw) + MASS p(w|u')) / (c(u) + MASS)``; the last one is add-one over tokens,
``(c(w) + 1) / (N + V + 1)``, so the failure weight of a state is ``MASS / (c(u) + MASS)``.

Nothing of the model is dropped, and it grows with the corpus, so it is held by no task. Documents are cut
into batches of about ``BATCH_TOKENS`` tokens. Each batch sends every distinct n-gram with its count once,
packed by range of a 64-bit hash; the task of a range sums the counts over all batches and returns to each
batch those of its own n-grams. From these a batch builds the part of the automaton that its documents can
reach. Ranges are as many as the tokens of the corpus ask for; a frequent n-gram comes once for each batch.

Edge cases: a null text is empty; the end of a text is a token; a document with a null doc_id is for training;
repeated rows count each; without training documents all tokens are unknown; an empty table gives an empty
result; further columns are ignored. N-grams are told apart by 64-bit hashes: a billion of them hold about
0.03 pairs with equal ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_sql, read_table, written

ORDER = 2
MASS = 4.0
BATCH_TOKENS = 2_000_000
RANGE_GRAMS = 4_000_000
START, END = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" start", b" end"))  # no word has a space


def tokens_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Lower-cased words of texts: distinct words, their codes in order, words of each text."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets)
    kept = np.asarray(pc.greater(pc.binary_length(flat), 0))
    counts = np.diff(np.concatenate([[0], np.cumsum(kept)])[offsets - offsets[0]])
    coded = flat.filter(pa.array(kept)).dictionary_encode()
    return [w.encode() for w in coded.dictionary.to_pylist()], np.asarray(coded.indices), counts


def encode_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the tokens of a batch, the codes of all its texts with start and end, tokens of each text."""
    words, codes, counts = tokens_of(texts)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    known = np.unique(np.concatenate([hashes, [START, END]]))
    place = np.searchsorted(known, np.concatenate([hashes, [START, END]])).astype(np.uint32)
    ends = np.cumsum(counts + 2)
    out = np.empty(len(codes) + 2 * len(counts), np.uint32)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = inner[ends - counts - 2] = False
    out[inner], out[ends - 1], out[ends - counts - 2] = place[codes], place[-1], place[-2]
    return known, out, counts + 2


BATCHES = "batch long, doc_ids array<long>, train array<boolean>, lengths binary, words binary, codes binary, n_tokens long"


def _encode_batches(batch_tokens: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, train, parts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            words, codes, lengths = encode_batch(pa.concat_arrays(parts))
            raw = [x.tobytes() for x in (lengths.astype(np.uint32), words, codes)]
            columns = [pa.array([(part << 32) + made]), pa.array([ids], pa.list_(pa.int64())), pa.array([train], pa.list_(pa.bool_()))]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([r], pa.binary()) for r in raw], pa.array([len(codes)])], [c.split()[0] for c in BATCHES.split(", ")])

        for batch in batches:
            texts = batch.column(2)
            for at in range(0, len(texts), 256):
                piece = texts.slice(at, 256)
                ids += batch.column(0).slice(at, 256).to_pylist()
                train += batch.column(1).slice(at, 256).to_pylist()
                parts.append(piece)
                size += (pc.sum(pc.binary_length(piece)).as_py() or 0) // 6 + 2 * len(piece)  # about six bytes a token
                if size >= batch_tokens:
                    yield flush()
                    ids, train, parts, size = [], [], [], 0
                    made += 1
        if ids:
            yield flush()

    return encode


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Grams:
    """The distinct n-grams of one length in a batch: sorted keys, where each stands first, and which one ends at a position."""

    def __init__(self, keys: np.ndarray, first: np.ndarray, at: np.ndarray):
        self.keys, self.first, self.at = keys, first, at


def grams_of(words: np.ndarray, codes: np.ndarray, lengths: np.ndarray, order: int) -> list[Grams]:
    codes = codes.astype(np.int64)
    first = np.empty(len(words), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    levels = [Grams(words, first, codes)]
    ends = np.cumsum(lengths)
    inside = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
    hashes, keys = words[codes], words[codes]
    for m in range(2, order + 1):
        keys = np.concatenate([[np.uint64(0)], _mix(keys[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] + np.uint64(m))])
        valid = np.flatnonzero(inside >= m - 1)
        distinct, where, back = np.unique(keys[valid], return_index=True, return_inverse=True)
        at = np.full(len(codes), -1, np.int64)
        at[valid] = back
        levels.append(Grams(distinct, valid[where], at))
    return levels


def _pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as differences, byte planes apart."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps[1:].max() if len(steps) > 1 else 0).bit_length() + 7) // 8)
    planes = steps[1:].view(np.uint8).reshape(-1, 8)[:, :width]
    return values[:1].astype("<u8").tobytes() + bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    width = raw[8]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[9:]), np.uint8).reshape(width, -1)
    steps = np.zeros((planes.shape[1] + 1, 8), np.uint8)
    steps[1:, :width] = planes.T
    steps[0] = np.frombuffer(raw[:8], np.uint8)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _pack_counts(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<i8").tobytes())


def _unpack_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i8")


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["words"], np.uint64), np.frombuffer(row["codes"], np.uint32), np.frombuffer(row["lengths"], np.uint32).astype(np.int64)


COUNTS = "range int, batch long, level int, grams binary, counts binary"


def _send_grams(order: int, bits: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, codes, lengths = _arrays(row)
                train = np.repeat(np.array(row["train"], bool), lengths)
                for level, grams in enumerate(grams_of(words, codes, lengths, order), 1):
                    counts = np.bincount(grams.at[train & (grams.at >= 0)], minlength=len(grams.keys))
                    ranges = (grams.keys >> np.uint64(64 - bits)).astype(np.int32)
                    cuts = np.flatnonzero(np.diff(ranges, prepend=-1))
                    pieces = list(zip(cuts, np.append(cuts[1:], len(ranges)), strict=True))
                    columns = [
                        pa.array(ranges[cuts], pa.int32()), pa.array([row["batch"]] * len(cuts)), pa.array([level] * len(cuts), pa.int32()),
                        pa.array([_pack(grams.keys[a:b]) for a, b in pieces], pa.binary()), pa.array([_pack_counts(counts[a:b]) for a, b in pieces], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COUNTS.split(", ")])

    return send


ANSWERS = "batch long, level int, range int, counts binary, n_tokens long, n_types long"


def _sum_range(group: pa.Table) -> pa.Table:
    """Counts of the n-grams of a range over all batches, for each batch in the order of its own; tokens and distinct ones as sums."""
    rows, out = group.to_pylist(), []
    for level in sorted({r["level"] for r in rows}):
        own = [r for r in rows if r["level"] == level]
        keys = [_unpack(r["grams"]) for r in own]
        distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros(len(distinct), np.int64)
        np.add.at(totals, back, np.concatenate([_unpack_counts(r["counts"]) for r in own]))
        ends = np.cumsum([len(k) for k in keys])
        out += [(r["batch"], level, r["range"], _pack_counts(totals[back[e - len(k) : e]]), 0, 0) for r, k, e in zip(own, keys, ends, strict=True)]
        if level == 1:
            scored = totals[distinct != START]
            out.append((None, 1, own[0]["range"], None, int(scored.sum()), int((scored > 0).sum())))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in ANSWERS.split(", ")])


class Automaton:
    """States, arcs and failure arcs over the n-grams of a batch, with base-10 logarithms as weights."""

    def __init__(self, levels: list[Grams], counts: list[np.ndarray], n_tokens: int, n_types: int, mass: float):
        self.n_words = len(levels[0].keys)
        p = (counts[0] + 1) / (n_tokens + n_types + 1)
        self.word_weight = np.log10(p)
        bases = np.cumsum([1, *[len(g.keys) for g in levels]])  # state 0 is the empty context
        self.fail_to, self.fail_weight = np.zeros(bases[-1], np.int64), np.zeros(bases[-1])
        self.word_next = np.where((counts[0] > 0) & (len(levels) > 1), 1 + np.arange(self.n_words), 0)
        arcs = []
        for m, (grams, c) in enumerate(zip(levels, counts, strict=True), 1):
            if m > 1:
                suffix, prefix = levels[m - 2].at[grams.first], levels[m - 2].at[grams.first - 1]
                p = (c + mass * p[suffix]) / (counts[m - 2][prefix] + mass)
                seen = np.flatnonzero(c > 0)
                own = bases[m - 1] + seen if m < len(levels) else bases[m - 2] + suffix[seen]
                arcs.append(((bases[m - 2] + prefix[seen]) * self.n_words + levels[0].at[grams.first[seen]], np.log10(p[seen]), own))
                self.fail_to[bases[m - 1] : bases[m]] = bases[m - 2] + suffix
            self.fail_weight[bases[m - 1] : bases[m]] = np.log10(mass / (c + mass))
        keys, weights, nexts = (np.concatenate([a[i] for a in arcs] or [[]]) for i in range(3))
        order = np.argsort(keys)
        self.arc, self.arc_weight, self.arc_next = np.append(keys[order], -1).astype(np.int64), np.append(weights[order], 0), np.append(nexts[order], 0).astype(np.int64)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weights of reading one word in each of the states, and the states behind it."""
        state, weight, after = state.copy(), np.zeros(len(state)), np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            s, w = state[left], word[left]
            key = s * self.n_words + w
            j = np.searchsorted(self.arc[:-1], key)
            hit, empty = (self.arc[j] == key) & (s > 0), s == 0
            weight[left] += np.where(hit, self.arc_weight[j], np.where(empty, self.word_weight[w], self.fail_weight[s]))
            after[left] = np.where(hit, self.arc_next[j], self.word_next[w])
            state[left] = self.fail_to[s]
            left = left[~hit & ~empty]
        return weight, after

    def score(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of weights of all texts, each read once from left to right; texts side by side, longest first."""
        order = np.argsort(-lengths, kind="stable")
        begin = (np.cumsum(lengths) - lengths)[order]
        alive = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")  # texts longer than t
        total = np.zeros(len(lengths))
        state = self.word_next[codes[begin]]
        for t in range(1, len(alive)):
            n = alive[t]
            weight, state = self.step(state[:n], codes[begin[:n] + t])
            total[:n] += weight
        out = np.empty(len(lengths))
        out[order] = total
        return out


SCORES = "doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_batches(order: int, n_tokens: int, n_types: int, mass: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, codes, lengths = _arrays(row)
                levels = grams_of(words, codes, lengths, order)
                answers = sorted(row["answers"], key=lambda a: (a["level"], a["range"]))
                counts = [np.concatenate([_unpack_counts(a["counts"]) for a in answers if a["level"] == m] or [np.zeros(0, np.int64)]) for m in range(1, order + 1)]
                model = Automaton(levels, counts, n_tokens, n_types, mass)
                codes = levels[0].at
                begin = np.cumsum(lengths) - lengths
                base, known = np.where(words == START, 0, model.word_weight)[codes], (counts[0] > 0) & (words != START)
                columns = [
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["train"], pa.bool_()), lengths - 1, np.add.reduceat(known[codes].astype(np.int64), begin),
                    np.full(len(lengths), n_tokens), np.add.reduceat(base, begin), model.score(codes, lengths),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], [c.split()[0] for c in SCORES.split(", ")])

    return score


def score_documents(docs: DataFrame, train: Column, order: int = ORDER, mass: float = MASS) -> DataFrame:
    """Scores of all documents by the model of those for which ``train`` holds: ``SCORES``."""
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(train, F.lit(True)).alias("train"), "text")
    batches = written(own.mapInArrow(_encode_batches(BATCH_TOKENS), BATCHES), "lm-batches", compression="zstd")
    tokens = batches.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    bits = max(3, math.ceil(math.log2(max(1, order * tokens / RANGE_GRAMS))))
    sent = batches.drop("doc_ids").mapInArrow(_send_grams(order, bits), COUNTS)
    answers = written(sent.groupBy("range").applyInArrow(_sum_range, ANSWERS), "lm-answers")
    sums = answers.filter("batch IS NULL").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_types"), F.lit(0))).first()
    own = answers.filter("batch IS NOT NULL").groupBy("batch").agg(F.collect_list(F.struct("level", "range", "counts")).alias("answers"))
    return batches.join(own, "batch").mapInArrow(_score_batches(order, sums[0], sums[1], mass), SCORES)


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = score_documents(read_table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op12_lm_scoring": op12_lm_scoring}
ORACLE_SQL = {
    "op12_lm_scoring": f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({crc32_sql("doc_id::varchar")} % 7 = 2, false) AS held_out, list_concat(['s '],
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), ['e ']) AS words FROM documents),
t AS (SELECT r, held_out, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT r, held_out, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS u FROM t),
c1 AS (SELECT w, count(*) AS c FROM g WHERE NOT held_out GROUP BY w),
c2 AS (SELECT u, w, count(*) AS c FROM g WHERE NOT held_out AND u IS NOT NULL GROUP BY u, w),
n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c1 WHERE w <> 's '),
p AS (SELECT r, c1.c IS NOT NULL AS known, (coalesce(c1.c, 0) + 1.0::double) / (n + v + 1) AS p1, coalesce(c2.c, 0) AS c_uw, coalesce(cu.c, 0) AS c_u
  FROM g CROSS JOIN n LEFT JOIN c1 ON c1.w = g.w LEFT JOIN c1 cu ON cu.w = g.u LEFT JOIN c2 ON c2.u = g.u AND c2.w = g.w WHERE i > 1)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (known) AS n_known, (SELECT n::bigint FROM n) AS train_tokens,
  sum(log10(p1)) AS base_score, sum(log10((c_uw + {MASS} * p1) / (c_u + {MASS}))) AS score FROM p JOIN d USING (r) GROUP BY r, doc_id"""
}
