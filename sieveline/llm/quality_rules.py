"""Quality rules as weak supervision (operator 6).

Every rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of
vote patterns estimates each rule's accuracies and the share of good documents; a document is kept
when its posterior probability of being good reaches the threshold and no hard base rule fails.

Two passes: the texts are read once into a narrow statistics table, and the vote patterns (at most
``3 ** len(RULES)``, however many documents there are) are counted from that table. The pattern
table is small by construction, so the join with it may broadcast.

Edge cases: a null or empty text has no words and fails the length rule; repeated rows are judged
one by one; an empty table gives an empty result; a null ``doc_id`` stays null; further columns are
ignored by ``score_documents`` and kept by ``filter_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
KEEP_AT = 0.5
BAD_WEIGHT = 4.0

STAT_COLUMNS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_distinct n_upper n_letters n_ends n_bangs n_kinds"
).split()
_UPPER = bytes(range(65, 91))
_NOT_UPPER = bytes(b for b in range(256) if b not in _UPPER)
_NOT_LETTER = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))
_ENDS = (b".", b"!", b"?", b'"', "”".encode(), "…".encode())


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Positions covered by ``window``-word windows that occur twice or more; ``window`` is a power of two."""
    rank, width = ids.astype(np.int64), 1
    while width < window:
        if len(rank) <= width:
            return 0
        left, right = rank[:-width], rank[width:]
        values, rank, counts = np.unique(left * (right.max() + 1) + right, return_inverse=True, return_counts=True)
        if len(values) == len(rank):
            return 0
        width *= 2
    starts = np.flatnonzero(counts[rank] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The values of ``STAT_COLUMNS`` for one text; words are runs without ASCII white space."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split() knows exactly the six ASCII white-space characters
    if not words:
        return (0,) * len(STAT_COLUMNS)
    symbols = [text.count(c) for c in SYMBOLS]
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault(w, len(seen)) for w in words]
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in " \t\n\v\f\r"),
        sum(symbols),
        len(lines) - len(set(lines)),
        repeated_words(np.array(ids)) if len(ids) > WINDOW else 0,
        len(lines),
        len(seen),
        len(raw.translate(None, _NOT_UPPER)),
        len(raw.translate(None, _NOT_LETTER)),
        sum(line.rstrip().endswith(_ENDS) for line in lines),
        text.count("!"),
        sum(50 * n > len(words) for n in symbols),
    )


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_stats(t.as_py()) for t in batch.column(1)]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(STAT_COLUMNS))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *STAT_COLUMNS])


def document_stats(docs: DataFrame) -> DataFrame:
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in STAT_COLUMNS)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_stats_batches, schema)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rule_votes() -> dict[str, Column]:
    """Rule name to its vote; ratios are compared by multiplication, so no rule divides by zero."""
    c = F.col
    n = c("n_words")
    return {
        "length": _vote(n >= 50, n < MIN_WORDS),
        "symbols": _vote(100 * c("n_symbols") < n, 10 * c("n_symbols") > n),
        "symbol_share": _vote(500 * c("n_symbols") < c("word_chars"), 50 * c("n_symbols") > c("word_chars")),
        "symbol_kinds": _vote(c("n_kinds") == 0, c("n_kinds") > 0),
        "dup_lines": _vote(c("n_dup_lines") == 0, 10 * c("n_dup_lines") > 3 * c("n_lines")),
        "repeats": _vote(20 * c("n_repeat_words") < n, 100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * n),
        "word_length": _vote(c("word_chars").between(3 * n, 8 * n), (2 * c("word_chars") < 5 * n) | (c("word_chars") > 12 * n)),
        "capitals": _vote(20 * c("n_upper") < 3 * c("n_letters"), 10 * c("n_upper") > 3 * c("n_letters")),
        "line_ends": _vote(2 * c("n_ends") >= c("n_lines"), 10 * c("n_ends") < c("n_lines")),
        "bangs": _vote(50 * c("n_bangs") < n, 10 * c("n_bangs") > n),
        "variety": _vote((20 * c("n_distinct") > 7 * n), (n >= 50) & (5 * c("n_distinct") < n)),
    }


RULES = ("length", "symbols", "symbol_share", "symbol_kinds", "dup_lines", "repeats", "word_length", "capitals", "line_ends", "bangs", "variety")


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 100, smoothing: float = 1.0) -> np.ndarray:
    """Posterior probability of "good" for each vote pattern, by expectation-maximisation.

    votes: patterns x rules in {-1, 0, 1}; counts: documents with each pattern. Starts from a soft
    vote and keeps its orientation, so "good" can't change places with "bad". In the start a bad vote
    weighs ``BAD_WEIGHT`` good ones: the rules name defects, and most texts pass most of them.
    """
    if not len(votes):
        return np.zeros(0)
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    start = good = 1 / (1 + np.exp(BAD_WEIGHT * (votes < 0).sum(axis=1) - (votes > 0).sum(axis=1)))
    for _ in range(rounds):
        log = []
        for side in (good, 1 - good):
            weight = side * counts
            table = np.einsum("p,prv->rv", weight, one_hot) + smoothing
            table /= table.sum(axis=1, keepdims=True)
            prior = (weight.sum() + smoothing) / (counts.sum() + 2 * smoothing)
            log.append(np.log(prior) + np.einsum("prv,rv->p", one_hot, np.log(table)))
        new = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
        done, good = np.abs(new - good).max() < 1e-9, new
        if done:
            break
    agrees = np.sum(counts * (good - 0.5) * (start - 0.5))
    return good if agrees >= 0 else 1 - good


def score_documents(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """One row per document: base statistics, ``base_failed``, the posterior ``quality`` and ``kept``."""
    spark = docs.sparkSession
    stats = written(document_stats(docs), "quality-stats")
    votes = stats.withColumns({f"vote_{name}": vote for name, vote in rule_votes().items()})
    keys = [f"vote_{name}" for name in RULES]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # what the base rules reject anyway doesn't train the model: else "bad" comes to mean "short"
    patterns = votes.groupBy(*keys).agg(F.count_if(~failed).alias("count")).toPandas()
    patterns["quality"] = fit_label_model(patterns[keys].to_numpy(), patterns["count"].to_numpy(float))
    rows = [(*map(int, r[:-1]), float(r[-1])) for r in patterns[[*keys, "quality"]].itertuples(index=False)]
    model = spark.createDataFrame(rows, ", ".join(f"{k} int" for k in keys) + ", quality double")
    return (
        votes.join(F.broadcast(model), keys)  # at most 3 ** len(RULES) rows
        .select("doc_id", *STAT_COLUMNS[:5], failed.alias("base_failed"), "quality")
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_at))
    )


def filter_documents(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows that the rules keep, with all their columns.

    The verdict goes by ``doc_id`` and text: rows that repeat a ``doc_id`` are judged each by its own text,
    and rows with a null ``doc_id`` stay if their text passes.
    """
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    scored = score_documents(keyed.withColumn("doc_id", F.col("row_key")), keep_at)
    kept = scored.filter("kept").select(F.col("doc_id").alias("row_key")).distinct()
    return keyed.join(kept, "row_key", "left_semi").select(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(read_table(spark, sf_dir, "documents"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"
    )


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE_SQL: dict[str, str] = {}
