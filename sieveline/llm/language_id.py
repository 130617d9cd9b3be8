"""Language identification with labelled spans (operator 1).

Training counts hashed letter n-grams of each word by language, and letters by script and language,
over all labelled documents that are not held out; the counts are summed by Spark, and the model is
a table of fixed size, ``BUCKETS`` numbers for each language.

Prediction: the script of a word's letters narrows the languages it may have; each word gets a log
probability for each of those; Viterbi with a switching penalty labels the words, so that a text in
several languages falls into spans. The document's language is the one with most letters in its
spans (ties: the first in alphabetical order) and ``score`` is its share of all letters.

Viterbi runs over whole texts for many documents at once: the documents of a batch are sorted by
length, and step t advances all that have a word t.

Edge cases: a null text, or one without letters, is ``und`` with score 0; a text of letters in a
script that no language was seen in gets the most frequent languages by prior; without any training
row every document is ``und``; repeated rows are predicted one by one; null labels don't train;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SWITCH_PENALTY = 12.0
SCRIPT_SHARE = 0.001
#: \w has these too, but they are no letters: superscripts, fractions, Roman and circled numbers
NUMERALS = "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
WORD = re.compile(rf"[^\W\d_{NUMERALS}]+")
WORD_OR_NUMERAL = re.compile(r"[^\W\d_]+")
#: first code point of each script block, fixed values; what lies between named blocks is "other"
SCRIPTS = (
    (0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([start for start, _ in SCRIPTS])
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])
BATCH_CHARACTERS = 3 << 20


def words_of(text: str) -> list[str]:
    """``WORD.findall(text)``. Its many characters are tried one by one at every place, so only what has a numeral in it meets them."""
    found = WORD_OR_NUMERAL.findall(text)
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in ((x,) if x.isalpha() else WORD.findall(x))]


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of the words, the index of each n-gram's word, each word's length and script."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(f" {w} " for w in words).lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    # lower-casing may lengthen a word: borders are taken from the blanks themselves
    blank = code == 32
    word = (np.cumsum(blank) - 1) // 2  # both blanks around a word are its own
    scripts = _SCRIPT_OF[np.searchsorted(_STARTS, code.astype(np.int64), side="right") - 1]
    first_letter = np.flatnonzero(blank)[::2] + 1
    grams, owner = [], []
    for n in ORDERS:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint64)
        inside = np.ones(len(h), bool)
        for i in range(n):
            h = (h ^ code[i : len(code) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = word[: len(h)] == word[n - 1 :]
        if n == 1:
            inside &= ~blank
        grams.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
        owner.append(word[: len(h)][inside])
    return np.concatenate(grams), np.concatenate(owner), lengths, scripts[np.minimum(first_letter, len(scripts) - 1)]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the task: for each language the n-gram buckets, then the scripts as buckets past the end."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        by_lang: dict[str, dict[str, int]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = by_lang.setdefault(lang, {})
            for w in words_of(text):
                counts[w] = counts.get(w, 0) + 1
        for lang, counts in by_lang.items():
            if not counts:
                continue
            words = list(counts)
            times = np.fromiter(counts.values(), np.float64, len(words))
            grams, owner, lengths, scripts = word_grams(words)
            total = totals.setdefault(lang, np.zeros(BUCKETS + len(SCRIPT_NAMES)))
            total[:BUCKETS] += np.bincount(grams, times[owner], BUCKETS)
            total[BUCKETS:] += np.bincount(scripts, times * lengths, len(SCRIPT_NAMES))
    for lang, total in totals.items():
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full)), pa.array(full, pa.int32()), pa.array(total[full].astype(np.int64))], ["lang", "bucket", "n"])


@dataclass
class Model:
    langs: list[str]
    score: np.ndarray  # BUCKETS x langs: log probability of an n-gram
    allowed: np.ndarray  # scripts x langs
    prior: np.ndarray

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """words x langs log probabilities, and letters in each word."""
        grams, owner, lengths, scripts = word_grams(words)
        out = np.stack([np.bincount(owner, self.score[grams, k], len(words)) for k in range(len(self.langs))], axis=1)
        allowed = self.allowed[scripts]
        allowed |= ~allowed.any(axis=1, keepdims=True)
        return np.where(allowed, out, -1e4).astype(np.float32), lengths


def train(docs: DataFrame) -> Model:
    """A model from rows with text and lang; one row of sums of fixed size reaches the driver for each language, never texts.

    The model takes ``4 * BUCKETS`` bytes for each language, 128 KB; all the languages that have a code (about 8,000) take 1 GB.
    """
    rows = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    counted = rows.mapInArrow(_count_batches, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = counted.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts")).collect()
    packed = sorted(packed, key=lambda r: r.lang)
    langs = [r.lang for r in packed]
    table = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
    for k, r in enumerate(packed):
        table[r.buckets, k] = r.counts
    grams, letters = table[:BUCKETS] + 0.5, table[BUCKETS:]
    score = np.log(grams / grams.sum(axis=0)) if langs else grams
    share = letters / np.maximum(letters.sum(axis=0), 1)
    prior = np.log((letters.sum(axis=0) + 1) / (letters.sum() + max(1, len(langs))))
    return Model(langs, score.astype(np.float32), share >= SCRIPT_SHARE, prior.astype(np.float32))


def viterbi(scores: np.ndarray, begin: np.ndarray, length: np.ndarray, prior: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best label of each row of ``scores``; sequence i is rows begin[i] .. begin[i] + length[i], longest first."""
    states = scores.shape[1]
    stayed = np.empty((len(scores), states), bool)
    best_before = np.empty(len(scores), np.int16)
    most = int(length[0]) if len(length) else 0
    active = len(length) - np.searchsorted(length[::-1], np.arange(most), side="right")  # sequences with a word t
    value = scores[begin] + prior
    ends = value.copy()
    for t in range(1, most):
        k = active[t]
        value = value[:k]
        at = begin[:k] + t
        top = value.argmax(axis=1)
        jump = (value[np.arange(k), top] - penalty)[:, None]
        stay = value >= jump
        value = np.where(stay, value, jump) + scores[at]
        stayed[at], best_before[at] = stay, top
        ends[:k] = value
    labels = np.empty(len(scores), np.int16)
    state = ends.argmax(axis=1).astype(np.int16)
    for t in range(most - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        labels[at] = state[:k]
        if t:
            state[:k] = np.where(stayed[at, state[:k]], state[:k], best_before[at])
    return labels


def label_spans(model: Model, texts: list[str | None]) -> list[list[tuple[int, int, str, int]]]:
    """For each text its spans (first word, last word, language, letters) in order."""
    found = [words_of(t) if t else [] for t in texts]
    seen: dict[str, int] = {}
    ids = [np.fromiter((seen.setdefault(w, len(seen)) for w in ws), np.int32, len(ws)) for ws in found]
    out: list[list[tuple[int, int, str, int]]] = [[] for _ in texts]
    order = [i for i in sorted(range(len(texts)), key=lambda i: -len(ids[i])) if len(ids[i])]
    if not order or not model.langs:
        return out
    del found
    by_word, letters = model.word_scores(list(seen))
    length = np.array([len(ids[i]) for i in order])
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    flat = np.concatenate([ids[i] for i in order])
    labels = viterbi(by_word[flat], begin, length, model.prior)
    size = letters[flat]
    for b, n, i in zip(begin, length, order, strict=True):
        own, sizes = labels[b : b + n], size[b : b + n]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        sums = np.add.reduceat(sizes, starts)
        stops = np.concatenate([starts[1:], [n]])
        out[i] = [(int(s), int(e) - 1, model.langs[own[s]], int(z)) for s, e, z in zip(starts, stops, sums, strict=True)]
    return out


def document_language(spans: list[tuple[int, int, str, int]]) -> tuple[str, float]:
    sums: dict[str, int] = {}
    for _, _, lang, letters in spans:
        sums[lang] = sums.get(lang, 0) + letters
    if not sums:
        return "und", 0.0
    lang = min(sums, key=lambda k: (-sums[k], k))
    return lang, sums[lang] / sum(sums.values())


SPAN = "array<struct<first_word:int,last_word:int,lang:string,letters:int>>"


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and ``spans`` for each document."""
    most = BATCH_CHARACTERS * 4 // max(4, len(model.langs))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers for each language, however large the input
    span = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("lang", pa.string()), ("letters", pa.int32())]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i] or ""))  # long texts share their steps
            at = 0
            while at < len(order):
                stop, size = at, 0
                while stop < len(order) and (size < most or stop == at):
                    size += len(texts[order[stop]] or "")
                    stop += 1
                some = order[at:stop]
                spans = label_spans(shared.value, [texts[i] for i in some])
                best = [document_language(s) for s in spans]
                rows = [[dict(zip(("first_word", "last_word", "lang", "letters"), s, strict=True)) for s in one] for one in spans]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(some)), pa.array([b[0] for b in best]), pa.array([b[1] for b in best], pa.float64()), pa.array(rows, span)],
                    ["doc_id", "lang_pred", "score", "spans"],
                )
                at = stop

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, f"doc_id long, lang_pred string, score double, spans {SPAN}")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    spans = identify(docs, model)
    return spans.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict[str, str] = {}
