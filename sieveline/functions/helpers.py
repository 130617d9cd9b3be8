"""The vectorized helpers: scores that need dot products or loops over one sequence."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from .matching import matching_ratio, matching_ratios  # noqa: F401  (the ratio of one pair is imported from here)
from .scales import ACIDS, BASES, C_TERMINUS, N_TERMINUS, PROPERTIES, RESIDUES

LAGS, CROSS_LAGS, LEAST_LENGTH = 30, 5, 37
_CODE = np.full(256, -1)
for _i, _aa in enumerate(RESIDUES):
    _CODE[ord(_aa)] = _i
_TABLE = np.array([PROPERTIES[aa] for aa in RESIDUES])
_NORM_WEIGHT = {0: 0.30, 2: 0.25, 3: 0.20, 4: 0.15}


def words_of(sequence: Column, size: int | Column) -> Column:
    """All overlapping words of this length, in order, in one pass over the sequence (``substr`` at each start is quadratic)."""
    size = F.lit(str(size)) if isinstance(size, int) else size.cast("string")
    return F.regexp_extract_all(sequence, F.concat(F.lit("(?s)(?=(.{"), size, F.lit("}))")), F.lit(1))


WORD_ROWS = 1 << 15
HASHED_ROWS = 1 << 14  # what a step of the hash touches stays in the cache
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_PLACES = ((1, 0), (5, 1), (3, 5), (7, 0))
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def md5_digits(words: np.ndarray, key: bytes) -> np.ndarray:
    """The first four hexadecimal digits, as numbers, of the MD5 of each row of letters (a matrix of bytes) with ``key`` behind: one block."""
    if words.shape[1] + len(key) > 55:
        raise ValueError("word and key are longer than one block")
    out = np.empty(len(words), np.int32)
    size = words.shape[1]
    for low in range(0, len(words), HASHED_ROWS):
        some = words[low : low + HASHED_ROWS]
        rest = key + b"\x80"
        block = np.zeros((len(some), 64), np.uint8)
        block[:, :size] = some
        block[:, size : size + len(rest)] = np.frombuffer(rest, np.uint8)
        block[:, 56:58] = np.frombuffer((8 * (size + len(key))).to_bytes(2, "little"), np.uint8)
        x = np.ascontiguousarray(block.view("<u4").T)
        a, b, c, d = (np.full(len(some), v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        f, high = np.empty_like(a), np.empty_like(a)
        for i in range(61):  # b of this step is the first number of the end
            turn = i // 16
            if turn < 2:
                p, q, r = ((c, d, b), (b, c, d))[turn]
                np.bitwise_xor(p, q, out=f)
                f &= r
                f ^= q
            elif turn == 2:
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                np.invert(d, out=f)
                f |= b
                f ^= c
            at = (_PLACES[turn][0] * i + _PLACES[turn][1]) % 16
            f += a
            if 4 * at < size:
                f += x[at]
                f += np.uint32(_SINES[i])
            else:
                f += np.uint32((_SINES[i] + int(x[at, 0])) % 2**32)
            shift = _SHIFTS[turn][i % 4]
            np.right_shift(f, np.uint32(32 - shift), out=high)
            f <<= np.uint32(shift)
            f |= high
            f += b
            a, b, c, d, f = d, f, b, c, a
        b += np.uint32(0x67452301)
        out[low : low + HASHED_ROWS] = ((b & 0xFF) << 8) | ((b >> 8) & 0xFF)
    return out


def word_rows(rows: DataFrame, size: int, keys: Sequence[str] = (), most: int | None = None, best: int | None = None) -> DataFrame:
    """``rows`` with their ``sequence`` (ASCII letters) replaced by its overlapping words, one row each: 1-based ``start`` and ``peptide``.

    Windows of the letters of a whole Arrow batch, given out in batches of ``WORD_ROWS``: no array of all words of a sequence is built.
    With keys each word comes once for each ``key``, with the ``digits`` of their hash: only up to ``most``, or only those that are among the
    ``best`` lowest of the sequence, and some more, as ties and all that is low within a batch stay.
    """
    keep = rows.drop("sequence").schema
    kinds = StructType([*keep.fields]).add("start", IntegerType()).add("peptide", StringType())
    if keys:
        kinds = kinds.add("key", StringType()).add("digits", IntegerType())

    def lowest(row: np.ndarray, own: np.ndarray, digits: np.ndarray) -> np.ndarray:
        ranked = row << 16 | digits
        stop = np.cumsum(own)
        most_of = np.sort(ranked)[np.minimum(stop - own + best, stop) - 1]
        return ranked <= np.repeat(most_of, own)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(s or "").encode("ascii") for s in batch.column(len(keep)).to_pylist()]
            lengths = np.array([len(r) for r in raw], np.int64)
            n = np.maximum(lengths - size + 1, 0)
            ends, begin, total = np.cumsum(n), np.cumsum(lengths) - lengths, int(n.sum())
            if not total:
                continue
            windows = sliding_window_view(np.frombuffer(b"".join(raw), np.uint8), size)
            for low in range(0, total, WORD_ROWS):
                at = np.arange(low, min(low + WORD_ROWS, total))
                first, last = np.searchsorted(ends, [low, at[-1]], side="right")
                own = np.minimum(ends[first : last + 1], at[-1] + 1) - np.maximum((ends - n)[first : last + 1], low)
                row = np.repeat(np.arange(first, last + 1), own)
                at = at - (ends - n)[row]
                words = windows[begin[row] + at]
                for key in keys or (None,):
                    extra, kept = [], slice(None)
                    if key is not None:
                        digits = md5_digits(words, key.encode("ascii"))
                        kept = np.flatnonzero(digits <= most) if most is not None else np.flatnonzero(lowest(row, own, digits)) if best else kept
                        digits = digits[kept]
                        extra = [pa.array([key] * len(digits), pa.string()), pa.array(digits)]
                    starts = at[kept]
                    peptides = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.arange(0, size * len(starts) + 1, size, dtype=np.int32)), pa.py_buffer(words[kept].tobytes()))
                    index = pa.array(row[kept])
                    columns = [batch.column(i).take(index) for i in range(len(keep))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array((starts + 1).astype(np.int32)), peptides, *extra], kinds.names)

    spread = 4 * rows.sparkSession.sparkContext.defaultParallelism  # much work for few bytes: a file may be one task else
    return rows.select(*keep.names, "sequence").repartition(spread, *keep.names).mapInArrow(made, kinds)


UPPER = np.triu_indices(_TABLE.shape[1], 1)


def covariances(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Lagged covariances of the centred residue properties: lags x properties of their own, and lags x pairs (``UPPER``).

    Letter codes without properties drop out; None below ``LEAST_LENGTH`` residues.
    """
    code = _CODE[letters]
    x = _TABLE[code[code >= 0]]
    if len(x) < LEAST_LENGTH:
        return None
    x = x - x.mean(axis=0)
    auto = np.array([(x[:-lag] * x[lag:]).mean(axis=0) for lag in range(1, LAGS + 1)])
    return auto, np.array([(x[:-lag].T @ x[lag:] / (len(x) - lag))[UPPER] for lag in range(1, CROSS_LAGS + 1)])


def covariance_score(sequence: str) -> float | None:
    """Antigenicity from auto- and cross-covariances of residue properties; None below ``LEAST_LENGTH`` residues."""
    both = covariances(np.frombuffer(sequence.encode("ascii", "replace"), np.uint8))
    if both is None:
        return None
    auto, cross = both
    raw = sum(w * np.sqrt((auto[:, p] ** 2).sum()) for p, w in _NORM_WEIGHT.items())
    raw += 0.10 * np.sqrt((cross**2).sum())
    return float(1 / (1 + np.exp(-15.0 * (raw - 0.035))))


@F.pandas_udf(DoubleType())
def long_antigenicity(sequences: pd.Series) -> pd.Series:
    return sequences.map(lambda s: None if s is None else covariance_score(s))


_PK = BASES, ACIDS


def charge_at(counts: dict[str, np.ndarray], ph: np.ndarray) -> np.ndarray:
    """Net charges at these pH values of sequences with these numbers of letters."""
    plus = 1 / (1 + 10 ** (ph - N_TERMINUS)) + sum(counts[a] / (1 + 10 ** (ph - pk)) for a, pk in _PK[0].items())
    minus = 1 / (1 + 10 ** (C_TERMINUS - ph)) + sum(counts[a] / (1 + 10 ** (pk - ph)) for a, pk in _PK[1].items())
    return plus - minus


@F.pandas_udf(DoubleType())
def isoelectric_point(sequences: pd.Series) -> pd.Series:
    """pH of zero net charge, by bisection over a whole batch; null for an empty sequence."""
    counts = {a: sequences.str.count(a).fillna(0).to_numpy(np.float64) for table in _PK for a in table}
    low, high = np.zeros(len(sequences)), np.full(len(sequences), 14.0)
    for _ in range(50):
        mid = (low + high) / 2
        up = charge_at(counts, mid) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return pd.Series(np.round(low, 6)).where((sequences.str.len() > 0).to_numpy(bool, na_value=False))


@F.pandas_udf(DoubleType())
def identity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[known] = matching_ratios(list(zip(a[known], b[known], strict=True)))
    return pd.Series(out).where(known)
