"""Secret scans with a random forest that removes false positives (operator 10).

Candidates are cut from whole texts generously: private key blocks, known key shapes, values that are
assigned with ``=`` or ``:``, tokens of ``LEAST_LENGTH`` characters with a digit and of ``LONG_LENGTH`` without one. Each is described by its length, its character transitions, how much
of it dictionary words cover, the path (here: source) it was found under and its neighbouring words.
A random forest trained on labelled findings scores every candidate.

Labelled findings are a table of the caller's, or by default the candidates that one of the label
rules is sure about (known key shapes, key blocks and random values under a secret name, against
numbers, addresses, placeholders, and dictionary words without a secret name). What these rules look at (shape, name, placeholder, digits, entropy) is no
feature, but for the share of dictionary words, and the name of a value is cut out of its neighbouring words, so the forest learns from the rest of a candidate and its surroundings. The forest is fitted on at most ``LABELLED_ROWS`` of each label, chosen
by a hash of the finding's digest and place, so that equal findings can't crowd the others out; a
labelled table without these columns is chosen by a hash of its features. Every candidate of every
document is scored. The dictionary is the vocabulary of a public
tokenizer, whose path is a parameter.

Edge cases: a null or empty text has no candidate; equal candidates in one text are separate
findings; a null source is an empty path; without labelled findings of both kinds the label itself is
the score (unlabelled: 0.5); an empty table gives an empty result; further columns are ignored. The
secret itself isn't returned, only its SHA-256.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LABELLED_ROWS = 20_000
TREES, DEPTH, SEED = 30, 6, 10
LEAST_LENGTH = 12
LONG_LENGTH = 24
KEEP_AT = 0.5
WORDS_SHARE = 0.8  # of a value in dictionary words: an identifier or a path

TOKEN = re.compile(r"[A-Za-z0-9+/_\-]+={0,2}")
LONG_TOKEN = re.compile(rf"[A-Za-z0-9+/_\-]{{{LONG_LENGTH},}}={{0,2}}")
DIGIT = re.compile(r"[0-9]")
ASSIGNED = re.compile(r"""([A-Za-z_][A-Za-z0-9_\-]{1,40})["']?[ \t]{0,4}[=:]{1,2}[ \t]{0,4}["']?([^\s"'=:,;]{8,})""")
SECRET_WORD = re.compile(r"(?i)pass(?:word|wd)?|pwd|secret|token|api[_-]?key|auth|credential|private|bearer|access")
PLACEHOLDER = re.compile(r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|\*\*\*|test[_-]?(?:key|token)|0000000|1234567|abcdef|<|\$\{")
KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----(?:(?!-----BEGIN )[\s\S])*?-----END (?:[A-Z0-9]+ ){0,4}PRIVATE KEY(?: BLOCK)?-----")
KNOWN_SHAPES = (
    ("private_key", KEY_BLOCK),
    ("aws_access_key", re.compile(r"AKIA[0-9A-Z]{16}")),
    ("github_token", re.compile(r"gh[pousr]_[A-Za-z0-9]{36}")),
    ("slack_token", re.compile(r"xox[baprs]-[A-Za-z0-9-]{10,}")),
    ("google_api_key", re.compile(r"AIza[0-9A-Za-z_\-]{35}")),
    ("stripe_key", re.compile(r"sk_(?:live|test)_[0-9A-Za-z]{16,}")),
)
NUMBER = re.compile(r"[0-9][0-9+/_\-]*")
FEATURES = (
    "length uppers lowers others transitions case_flips hex longest_run vowels coverage longest_word "
    "path_test path_code path_depth left_secret right_secret left_digit neighbours_words"
).split()
PATH_TEST = re.compile(r"(?i)test|spec|mock|fixture|example|sample|doc")
PATH_CODE = re.compile(r"(?i)\.(?:env|ya?ml|json|ini|cfg|conf|pem|py|js|ts|java|go|rb|sh)$|config|secret")


@lru_cache(maxsize=2)
def dictionary(path: str) -> frozenset[str]:
    """Words of three letters or more in a tokenizer's vocabulary."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return frozenset(w for v in vocabulary if len(w := v.lstrip("Ġ").lower()) >= 3 and w.isalpha())


def covered(candidate: str, words: frozenset[str]) -> tuple[float, int]:
    """Share of the candidate that words cover, taking the longest at each place, and the longest word."""
    text, at, total, longest = candidate.lower(), 0, 0, 0
    while at < len(text):
        for n in range(min(14, len(text) - at), 2, -1):
            if text[at : at + n] in words:
                total, longest, at = total + n, max(longest, n), at + n
                break
        else:
            at += 1
    return total / len(text), longest


def kind_of(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


class Places:
    """Intervals that don't overlap, in order."""

    def __init__(self):
        self.begins: list[int] = []
        self.rows: list[tuple[int, int, str]] = []

    def add(self, begin: int, end: int, key: str) -> None:
        """Adds an interval unless it overlaps one that is there."""
        i = bisect(self.begins, begin)
        if (i and self.rows[i - 1][1] > begin) or (i < len(self.rows) and self.begins[i] < end):
            return
        self.begins.insert(i, begin)
        self.rows.insert(i, (begin, end, key))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, key) of each candidate; key is the name that it is assigned to, or empty."""
    found = Places()
    if "-----BEGIN " in text:
        for m in KEY_BLOCK.finditer(text):
            found.add(*m.span(), "")
    if "=" in text or ":" in text:
        for m in ASSIGNED.finditer(text):
            if SECRET_WORD.search(m[1]) or DIGIT.search(m[2]):
                found.add(*m.span(2), m[1])
    for _, rx in KNOWN_SHAPES[1:]:
        for m in rx.finditer(text):
            found.add(*m.span(), "")
    at = 0
    while m := DIGIT.search(text, at):
        begin = m.start()
        while begin > at and TOKEN.match(text[begin - 1]):
            begin -= 1
        end = TOKEN.match(text, begin).end()
        if end - begin >= LEAST_LENGTH:
            found.add(begin, end, "")
        at = max(end, m.end())
    for m in LONG_TOKEN.finditer(text):
        found.add(*m.span(), "")
    return found.rows


def describe(text: str, begin: int, end: int, key: str, path: str, words: frozenset[str]) -> tuple[list[float], str, int | None]:
    """Features in the order of ``FEATURES``, the kind of finding and its label (None: not sure)."""
    s = text[begin:end]
    n = len(s)
    kinds = [kind_of(c) for c in s]
    steps = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    counts = Counter(s)
    entropy = -sum(v / n * math.log2(v / n) for v in counts.values())
    run = best = 1
    for a, b in zip(s, s[1:], strict=False):
        run = run + 1 if a == b else 1
        best = max(best, run)
    share, longest = covered(s, words)
    left, right = text[max(0, begin - 60) : begin], text[end : end + 60]
    if key:  # the name of the value isn't one of its neighbours: the label rules look at it
        left = left[: max(0, left.rfind(key[-60:]))]
    shape = next((name for name, rx in KNOWN_SHAPES if rx.fullmatch(s)), "")
    secret_key, placeholder = bool(SECRET_WORD.search(key)), bool(PLACEHOLDER.search(s))
    features = [
        n, kinds.count(1) / n, kinds.count(2) / n, kinds.count(3) / n, steps / n,
        sum({a, b} == {1, 2} for a, b in zip(kinds, kinds[1:], strict=False)) / n, sum(c in "0123456789abcdefABCDEF" for c in s) / n,
        best, sum(c in "aeiouAEIOU" for c in s) / n, share, longest,
        bool(PATH_TEST.search(path)), bool(PATH_CODE.search(path)), path.count("/"), bool(SECRET_WORD.search(left)),
        bool(SECRET_WORD.search(right)), bool(DIGIT.search(left[-20:])), len(left.split()) + len(right.split()),
    ]
    label = None
    if placeholder or NUMBER.fullmatch(s) or "@" in s or "://" in s or entropy < 2.5:
        label = 0
    elif shape or (secret_key and kinds.count(0) and entropy >= 3):
        label = 1
    elif share >= WORDS_SHARE and not secret_key:
        label = 0
    return [float(f) for f in features], shape or ("assigned" if key else "token"), label


def findings(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per candidate: doc_id, start, length, kind, sha256, features and label."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.int32())
    names = ["doc_id", "start", "length", "kind", "sha256", "features", "label"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dictionary(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text, path in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for begin, end, key in candidates(text or ""):
                    features, kind, label = describe(text, begin, end, key, path or "", words)
                    digest = hashlib.sha256(text[begin:end].encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((doc_id, begin, end - begin, kind, digest, features, label))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long"), "text", F.col("source").cast("string")).mapInArrow(
        scan, "doc_id long, start int, length int, kind string, sha256 string, features array<double>, label int"
    )


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, keep_at: float = KEEP_AT) -> DataFrame:
    """Every candidate with the forest's ``score`` and ``is_secret``.

    labelled: findings with ``features`` and ``label`` 0/1; by default those that the label rules decide.
    """
    found = written(findings(docs), "secret-findings")
    known = (found if labelled is None else labelled).filter("label IS NOT NULL")
    place = [c for c in ("sha256", "doc_id", "start") if c in known.columns] or ["features"]
    known = known.select("features", F.col("label").cast("double").alias("label"), F.xxhash64(*place).alias("place"))
    bounded = [known.filter(F.col("label") == label).orderBy("place").limit(LABELLED_ROWS) for label in (0.0, 1.0)]
    sample = written(bounded[0].union(bounded[1]).drop("place"), "secret-labelled")
    if sample.select("label").distinct().count() < 2:
        return found.withColumn("score", F.coalesce(F.col("label").cast("double"), F.lit(0.5))).withColumn("is_secret", F.col("score") >= keep_at).drop("features", "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="vector", labelCol="label")
    model = forest.fit(sample.select(array_to_vector("features").alias("vector"), "label"))
    scored = model.transform(found.withColumn("vector", array_to_vector("features")))
    score = F.get(vector_to_array("probability"), F.lit(1))
    return scored.select("doc_id", "start", "length", "kind", "sha256", score.alias("score"), (score >= keep_at).alias("is_secret"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read_table(spark, sf_dir, "documents"))


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLE_SQL: dict[str, str] = {}
