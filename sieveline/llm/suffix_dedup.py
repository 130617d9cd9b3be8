"""Removal of byte strings that repeat across documents, by sorted sampled suffixes (operator 7).

Every byte is removed that lies in a ``LENGTH``-byte string which also starts in a document with a
smaller ``doc_id``. Suffixes need comparing to that depth only, and only those that occur in two
documents, so the difference-cover algorithm runs like this:

1. Whole copies: of equal texts all but that with the smallest ``doc_id`` go at once. The others are
   packed into blocks of about ``BLOCK`` bytes, a written table that both passes below read.
2. Sample: the positions of a document whose number modulo ``PERIOD`` is in the difference cover
   ``COVER``. Any two positions have a shift below ``PERIOD`` that brings both into the sample, and a
   string of ``LENGTH`` bytes still has ``LENGTH - PERIOD + 1`` bytes behind it there.
3. Sort sampled triples: the three 8-byte words at a sampled position, sorted and named by a
   fingerprint. Each block exchanges its sorted names once, packed by range of names; which of them
   occur in two documents comes back as one bit for each. Names that don't are done: nothing equals
   the strings around them at that shift.
4. Merge: the remaining suffixes at sampled positions, with the bytes before them, are exchanged by
   a gram of their first ``LENGTH - PERIOD + 1`` bytes, sorted, and adjacent prefixes are compared byte by byte.
   For each shift, strings with equal bytes before and behind the sampled position meet, and all but
   those of the smallest document are repeats. Equal suffixes of one block are settled before that.
   Suffixes of each range are counted over all blocks before; those of a range with more than ``FULL`` times its
   share, and those whose name ``HOT_BLOCKS`` blocks have, are exchanged for ``HOT_SHIFTS`` shifts at a time, by all
   bytes that the strings at these shifts share, so that a frequent phrase, however short, spreads by what is around it.
5. Repeats of a document are united to spans and cut out of its bytes.

Fingerprints only choose what is compared: a collision costs a comparison and never a byte. Names have
about eight bits more than their number needs. No group is formed by document or by name: exchanged are
packed rows, one for each block and range, ranges are sized to about ``RANGE_BYTES`` and ``SUFFIX_BYTES``, and a passage that all documents share
counts once for each block and distinct context.

Names aren't recursed on: the cover leaves ``LENGTH - PERIOD + 1`` bytes behind a sampled position at every shift, less
than two levels of triples would need. In one table that we measured 18.0 % of all positions have 24 repeated bytes and
16.7 % have 32, so that a second level would drop little.

Edge cases: a null text is empty; texts shorter than ``LENGTH`` bytes keep all; rows that repeat a
``doc_id`` don't count as smaller than each other; a row with a null ``doc_id`` takes no part and
keeps all; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

LENGTH = 50
PERIOD = 21
COVER = (3, 6, 7, 12, 14)  # every difference modulo PERIOD occurs between two of these
TRIPLE = 24
BEFORE = PERIOD - 1  # bytes that a string may have before its sampled position
SHARED = LENGTH - BEFORE  # bytes that it has behind it at least
HOT_BLOCKS = 1024
FULL = 3
HOT_SHIFTS = 3
BLOCK = 4 << 20
RANGE_BYTES = 6 << 20  # of names
SUFFIX_BYTES = 24 << 20  # of suffixes with what is before them
BUCKET_NAMES = 1 << 18  # repeated names for each bucket of documents
GRAM = 12
BROADCAST_BYTES = 96 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sampled(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, position in all bytes) of the sampled positions that a whole triple starts at."""
    most = int(lengths.max(initial=0))
    own = np.flatnonzero(np.isin(np.arange(most) % PERIOD, COVER))
    counts = np.searchsorted(own, lengths - TRIPLE, side="right")
    doc = np.repeat(np.arange(len(lengths)), counts)
    begin = np.cumsum(lengths) - lengths
    return doc, own[np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)] + begin[doc]


def names_of(data: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """Fingerprints of ``bits`` bits of the triples at these positions."""
    if not len(at):
        return np.zeros(0, np.uint64)
    h = np.zeros(len(at), np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    for i in range(0, TRIPLE, 8):
        h = _mix((h + words[at + i]) * np.uint64(0x9E3779B97F4A7C15))
    return h >> np.uint64(64 - bits)


_ZIP = zstandard.ZstdCompressor(level=3)


def _zip(raw: bytes) -> bytes:
    return _ZIP.compress(raw)


def _pack(values: np.ndarray) -> bytes:
    """Numbers compressed byte by byte of their width, all first bytes first."""
    flat = np.ascontiguousarray(values)
    return _zip(np.ascontiguousarray(flat.view(np.uint8).reshape(-1, flat.itemsize).T).tobytes())


def _unpack(raw: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


BLOCKS = "block long, keys binary, lengths binary, data binary"


def _block_batches(most: int):
    """Texts of ``LENGTH`` bytes or more, with their (doc_id, text hash), about ``most`` bytes a row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, keys, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            data = _zip(b"".join(texts))
            values = (number, _pack(np.array(keys, np.int64)), _pack(np.array([len(t) for t in texts], np.int64)), data)
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["block", "keys", "lengths", "data"])

        for batch in batches:
            for doc_id, th, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(raw) < LENGTH:
                    continue
                keys.append((doc_id.as_py(), th.as_py())), texts.append(raw)
                size += len(raw)
                if size >= most:
                    yield row()
                    number, keys, texts, size = number + 1, [], [], 0
        if texts:
            yield row()

    return made


class Block:
    """Bytes, documents and names of one block."""

    def __init__(self, keys: bytes, lengths: bytes, data: bytes, bits: int):
        self.keys, self.lengths = _unpack(keys, np.int64).reshape(-1, 2), _unpack(lengths, np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.doc, self.at = sampled(self.lengths)
        self.name = names_of(self.data, self.at, bits)


def _name_batches(bits: int, low: int):
    """Sorted names of each block by range, and whether two documents of the block have them."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                block = Block(row["keys"], row["lengths"], row["data"], bits + low)
                order = np.argsort(block.name, kind="stable")
                name, doc = block.name[order], block.keys[block.doc[order], 0]
                first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]])[: len(name)])
                if not len(first):
                    continue
                many = np.maximum.reduceat(doc, first) > np.minimum.reduceat(doc, first)
                name = name[first]
                cut = np.searchsorted(name, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(low))
                some = np.flatnonzero(np.diff(cut))
                parts = [(name[cut[r] : cut[r + 1]] & np.uint64((1 << low) - 1)).astype(np.uint32) for r in some]
                rows = [[row["block"]] * len(some), some.tolist(), [_pack(np.diff(p, prepend=np.uint32(0))) for p in parts],
                        [np.packbits(many[cut[r] : cut[r + 1]]).tobytes() for r in some]]
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["block", "range", "names", "many"])

    return made


def _repeated_names(hot_blocks: int):
    """For each block of one range of names two bits for each name: whether two documents have it, whether many blocks have it."""

    def made(group: pd.DataFrame) -> pd.DataFrame:
        own = [np.cumsum(_unpack(x, np.uint32), dtype=np.uint32) for x in group["names"]]
        name = np.concatenate(own)
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(n)) for m, n in zip(group["many"], own, strict=True)])
        order = np.argsort(name, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
        sizes = np.diff(np.append(first, len(name)))
        repeated = np.empty(len(name), bool)
        repeated[order] = np.repeat((np.add.reduceat(many[order].astype(np.int64), first) > 0) | (sizes > 1), sizes)
        hot = np.empty(len(name), bool)
        hot[order] = np.repeat(sizes >= hot_blocks, sizes)
        ends = np.cumsum([len(n) for n in own])[:-1]
        parts = list(zip(np.split(repeated, ends), np.split(hot, ends), strict=True))
        packed = [_zip(np.packbits(np.concatenate(p)).tobytes()) for p in parts]
        return pd.DataFrame({"block": group["block"], "range": group["range"], "flags": packed, "size": [len(p) for p, _ in parts], "n": [int(p.sum()) for p, _ in parts]})

    return made


def _merged(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts by document, overlapping and adjacent ones as one."""
    order = np.lexsort((first, doc))
    doc, first, last = doc[order].astype(np.int64), first[order], last[order]
    if not len(doc):
        return doc, first, last
    reach = np.maximum.accumulate(doc << 32 | last)
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] > (reach[:-1] & 0xFFFFFFFF) + 1)]))
    return doc[cut], first[cut], reach[np.append(cut[1:], len(doc)) - 1] & 0xFFFFFFFF


RUNS = "bucket int, keys binary, counts binary, runs binary"


def _packed_runs(keys: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, bits: int) -> list[tuple]:
    """Merged runs in one row for each bucket of documents (rows of ``keys``): their keys, numbers of runs, and runs."""
    doc, first, last = _merged(doc, first, last)
    bucket = keys[doc, 1] & ((1 << bits) - 1)
    order = np.argsort(bucket, kind="stable")
    doc, runs, bucket = doc[order], np.stack([first, last], axis=1)[order].astype(np.int32), bucket[order]
    rows = []
    cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own, counts = np.unique(doc[a:b], return_counts=True)
        rows.append((int(bucket[a]), _pack(keys[own]), _pack(counts.astype(np.int32)), _pack(runs[a:b])))
    return rows


def _unite_runs(group: pd.DataFrame) -> pd.DataFrame:
    """The runs of each document of a bucket as few runs that don't touch: one row a document, pairs of int32."""
    keys = np.concatenate([_unpack(x, np.int64).reshape(-1, 2) for x in group["keys"]])
    counts = np.concatenate([_unpack(x, np.int32) for x in group["counts"]])
    runs = np.concatenate([_unpack(x, np.int32).reshape(-1, 2) for x in group["runs"]]).astype(np.int64)
    keys, index = np.unique(keys, axis=0, return_inverse=True)
    doc, first, last = _merged(np.repeat(index.ravel(), counts), runs[:, 0], runs[:, 1])
    raw = np.stack([first, last], axis=1).astype(np.int32).tobytes()
    ends = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc)).tolist()
    spans = [raw[8 * a : 8 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pd.DataFrame({"doc_id": keys[:, 0], "th": keys[:, 1], "spans": spans})


# of settled runs (negative range): keys, counts in ``docs`` and runs in ``places``
SUFFIXES = "range int, keys binary, docs binary, places binary, shifts binary, bytes binary"
_KINDS = (pa.int32(), *[pa.binary()] * 5)
_NAMES = [c.split()[0] for c in SUFFIXES.split(", ")]


def _ranges(after: np.ndarray, bits: int) -> np.ndarray:
    """The range of each suffix, from bytes that all its strings have: the least hash of the grams behind it.

    Neighbouring suffixes of a text mostly have the same least gram: they go the same way and are packed well together.
    """
    grams = sliding_window_view(after, GRAM, axis=1)
    least = np.full(len(after), np.iinfo(np.uint64).max, np.uint64)
    for i in range(grams.shape[1]):
        two = [np.ascontiguousarray(grams[:, i, j : j + 8]).view("<u8").ravel() for j in (0, GRAM - 8)]
        np.minimum(least, _mix((_mix(two[0] * np.uint64(0x9E3779B97F4A7C15)) + two[1]) * np.uint64(0x9E3779B97F4A7C15)), out=least)
    return (_mix(least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _spread(after: np.ndarray, before: np.ndarray, bits: int) -> np.ndarray:
    """The range of each suffix from all bytes that its strings have."""
    whole = np.concatenate([after, before, np.zeros((len(after), -(after.shape[1] + before.shape[1]) % 8), np.uint8)], axis=1)
    h = np.zeros(len(after), np.uint64)
    for word in np.ascontiguousarray(whole).view("<u8").T:
        h = _mix((h + word) * np.uint64(0x9E3779B97F4A7C15))
    return (_mix(h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _flags_of(block: Block, flags: list[dict]) -> np.ndarray:
    """Whether the name of each sampled position is repeated, and whether it is hot."""
    parts = [
        np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(f["flags"]), np.uint8), count=2 * f["size"]).reshape(2, -1)
        for f in sorted(flags, key=lambda f: f["range"])
    ]
    return np.concatenate(parts, axis=1)[:, np.unique(block.name, return_inverse=True)[1]] > 0


def _around(block: Block) -> np.ndarray:
    return sliding_window_view(np.concatenate([np.zeros(BEFORE, np.uint8), block.data, np.zeros(LENGTH, np.uint8)]), BEFORE + LENGTH)


def _common_ranges(around: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """The ranges of positions by the bytes that their strings at every shift have."""
    step = 1 << 17
    return np.concatenate([_ranges(around[at[i : i + step]][:, BEFORE : BEFORE + SHARED], bits) for i in range(0, len(at), step)] or [np.zeros(0, np.int64)])


def _count_ranges(bits: int, low: int, range_bits: int):
    """Suffixes of every range that the blocks of a task have; one number for each range is held."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << range_bits, np.int64)
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                block = Block(row["keys"], row["lengths"], row["data"], bits + low)
                repeated, hot = _flags_of(block, row["flags"])
                total += np.bincount(_common_ranges(_around(block), block.at[repeated & ~hot], range_bits), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["range", "n"])

    return made


def _suffix_batches(bits: int, low: int, range_bits: int, bucket_bits: int, full: bytes):
    """Remaining suffixes of each block by range; repeats within the block come out as runs (negative range)."""

    def of_block(row: dict) -> Iterator[pa.RecordBatch]:
        block = Block(row["keys"], row["lengths"], row["data"], bits + low)
        repeated, hot = _flags_of(block, row["flags"])
        around, ranges = _around(block), np.unpackbits(np.frombuffer(full, np.uint8)) > 0
        if ranges.any():
            chosen = np.flatnonzero(repeated & ~hot)
            hot[chosen[ranges[_common_ranges(around, block.at[chosen], range_bits)]]] = True
        for first in range(0, PERIOD, HOT_SHIFTS):
            yield from of_shifts(block, around, repeated & hot, first, min(first + HOT_SHIFTS, PERIOD) - 1, True)
        yield from of_shifts(block, around, repeated & ~hot, 0, PERIOD - 1, False)

    def of_shifts(block: Block, around: np.ndarray, chosen: np.ndarray, lowest: int, highest: int, spread: bool) -> Iterator[pa.RecordBatch]:
        doc, at = block.doc[chosen], block.at[chosen]
        begin = block.begin[doc]
        least, most = np.maximum(lowest, at + LENGTH - begin - block.lengths[doc]), np.minimum(highest, at - begin)
        some = least <= most
        if not some.any():
            return
        doc, at, least, most = doc[some], at[some], least[some], most[some]
        gathered = around[at]
        after, before = gathered[:, BEFORE:], gathered[:, :BEFORE][:, ::-1]
        after = np.where(np.arange(LENGTH) < (LENGTH - least)[:, None], after, 0)
        before = np.where(np.arange(BEFORE) < most[:, None], before, 0)
        whole = np.ascontiguousarray(np.concatenate([after, before], axis=1))
        del gathered, after, before
        ids, shifts = block.keys[doc, 0], least << 8 | most
        order = np.lexsort((ids, shifts, whole.view(f"S{BEFORE + LENGTH}").ravel()))
        whole, shifts, doc, at, ids = whole[order], shifts[order], doc[order], (at - block.begin[doc])[order], ids[order]
        fresh = np.concatenate([[True], (whole[1:] != whole[:-1]).any(axis=1) | (shifts[1:] != shifts[:-1])])
        first = np.flatnonzero(fresh)
        later = ids > np.repeat(ids[first], np.diff(np.append(first, len(ids))))
        settled = _packed_runs(block.keys, doc[later], at[later] - (shifts[later] & 255), at[later] - (shifts[later] >> 8), bucket_bits)
        rows: list[tuple] = [(-1 - bucket, *packed, None, None) for bucket, *packed in settled]
        whole, shifts, doc, at = whole[~later], shifts[~later], doc[~later], at[~later]
        common = whole[:, : LENGTH - highest]
        of = _spread(common, whole[:, LENGTH : LENGTH + lowest], range_bits) if spread else _ranges(common, range_bits)
        order = np.lexsort((at, doc, of))  # what overlaps in the text stands together
        whole, shifts, doc, at = whole[order], shifts[order], doc[order], at[order]
        cut = np.searchsorted(of[order], np.arange((1 << range_bits) + 1))
        for r in np.flatnonzero(np.diff(cut)):
            part = slice(cut[r], cut[r + 1])
            docs, index = np.unique(doc[part], return_inverse=True)
            text = _zip(np.concatenate([whole[part, LENGTH:][:, ::-1], whole[part, :LENGTH]], axis=1).tobytes())
            packed = (_pack(x.astype(np.int32)) for x in (index, at[part], shifts[part]))
            rows.append((int(r), _pack(block.keys[docs]), *packed, text))
        for i in range(0, len(rows), 2000):
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i : i + 2000]], k) for c, k in enumerate(_KINDS)], _NAMES)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from of_block(batch.slice(i, 1).to_pylist()[0])

    return made


def _sorted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts byte rows and compares neighbours: the order, and how many leading bytes each shares with the one before."""
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    ranked = rows[order]
    differ = ranked[1:] != ranked[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, np.concatenate([[-1], shared])


def _ranks(ranked: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """A number for each row, equal for rows with that many equal leading bytes."""
    rank = np.empty(len(ranked), np.int64)
    rank[ranked] = np.cumsum(shared < depth)
    return rank


def _later(ids: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Rows whose name a smaller id has; ids ascend."""
    ranked = np.argsort(name, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], name[ranked][1:] != name[ranked][:-1]]))
    return ranked[ids[ranked] > np.repeat(ids[ranked][first], np.diff(np.append(first, len(ranked))))]


def _compare_suffixes(bucket_bits: int):
    """Repeats of a smaller document among the suffixes of one range, as runs by bucket of documents.

    A negative range holds runs that are settled already and pass through. Suffixes that are equal with
    all that is before them are settled at once; of these the first stands for all in the comparison, and what is found of it goes for
    every place of its document.
    """

    def made(group: pd.DataFrame) -> pd.DataFrame:
        if group["range"].iloc[0] < 0:
            return pd.DataFrame({"bucket": -1 - group["range"], "keys": group["keys"], "counts": group["docs"], "runs": group["places"]})
        return pd.DataFrame(_packed_runs(*_repeats(group), bucket_bits), columns=["bucket", "keys", "counts", "runs"]).astype({"bucket": "int32"})

    return made


def _repeats(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of documents, and document, first and last start of each run of repeats."""
    pairs = [_unpack(x, np.int64).reshape(-1, 2) for x in group["keys"]]
    keys = np.concatenate(pairs)
    bases = np.cumsum([0, *map(len, pairs)])
    doc = np.concatenate([_unpack(x, np.int32).astype(np.int64) + b for x, b in zip(group["docs"], bases, strict=False)])
    at = np.concatenate([_unpack(x, np.int32) for x in group["places"]]).astype(np.int64)
    shifts = np.concatenate([_unpack(x, np.int32) for x in group["shifts"]])
    text = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x) for x in group["bytes"]), np.uint8).reshape(-1, BEFORE + LENGTH)
    order = np.argsort(keys[doc, 0], kind="stable")  # smaller documents first
    doc, at, shifts, text, ids = doc[order], at[order], shifts[order], text[order], keys[doc[order], 0]
    ranked, shared = _sorted(np.ascontiguousarray(np.concatenate([text, shifts.astype(">u2")[:, None].view(np.uint8)], axis=1)))
    whole = _ranks(ranked, shared, BEFORE + LENGTH + 2)
    later = _later(ids, whole)
    found = [(doc[later], at[later] - (shifts[later] & 255), at[later] - (shifts[later] >> 8))]
    values, one = np.unique(whole, return_index=True)  # the smallest document of each
    places = np.setdiff1d(np.arange(len(whole)), later, assume_unique=True)  # all places that it has them at
    places = places[np.argsort(whole[places], kind="stable")]
    size = np.bincount(np.searchsorted(values, whole[places]))
    begin, by = np.cumsum(size) - size, np.argsort(one)
    one, size, begin, all_docs, all_at = one[by], size[by], begin[by], doc, at
    doc, shifts, text, ids = doc[one], shifts[one], text[one], ids[one]
    after, before = _sorted(np.ascontiguousarray(text[:, BEFORE:])), _sorted(np.ascontiguousarray(text[:, :BEFORE][:, ::-1]))
    same = _ranks(*after, SHARED)
    several = np.bincount(same)[same] > 1
    for shift in range(PERIOD):
        own = np.flatnonzero(several & (shifts >> 8 <= shift) & ((shifts & 255) >= shift))
        if len(own) > 1:
            name = _ranks(*after, LENGTH - shift)[own] * (len(doc) + 1) + _ranks(*before, shift)[own]
            later = own[_later(ids[own], name)]
            n = size[later]
            every = places[np.repeat(begin[later] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            found.append((all_docs[every], all_at[every] - shift, all_at[every] - shift))
    return keys, *(np.concatenate(c) for c in zip(*found, strict=True))


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    for batch in batches:
        rows = []
        for doc_id, text, spans, copy in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            n_removed = n_spans = 0
            kept = raw
            if copy and len(raw) >= LENGTH:
                kept, n_removed, n_spans = b"", len(raw), 1
            elif spans:
                edge = np.zeros(len(raw) + 1, np.int32)
                runs = np.frombuffer(spans, np.int32).reshape(-1, 2)
                np.add.at(edge, runs[:, 0], 1)
                np.add.at(edge, runs[:, 1] + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                n_removed, n_spans = int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
            rows.append((doc_id, len(raw), n_removed, n_spans, hashlib.sha256(kept).hexdigest(), kept))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _small(rows: DataFrame, size) -> DataFrame:
    """Rows for a join: broadcast up to a checked size in bytes, else shuffled."""
    return F.broadcast(rows) if (rows.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else rows


def whole_copies(rows: DataFrame) -> DataFrame:
    """(doc_id, th) of rows whose text a row with a smaller doc_id has too."""
    digests = written(rows.select("doc_id", "th", F.unhex(F.sha2("text", 256)).alias("digest")).filter("digest IS NOT NULL"), "suffix-digests")
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    firsts = written(firsts.select("digest", "first"), "suffix-firsts")
    return written(digests.join(_small(firsts, F.lit(48)), "digest").filter("doc_id > first").select("doc_id", "th").distinct(), "suffix-copies")


def exchanged_suffixes(rows: DataFrame) -> tuple[DataFrame, int]:
    """The remaining suffixes of all blocks by range, and the bits of the buckets of documents."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    names = max(1, size * len(COVER) // PERIOD)
    bits = max(1, math.ceil(math.log2(1 + names * 4 / RANGE_BYTES)))
    low = min(32, max(16, math.ceil(math.log2(names)) + 8 - bits))
    blocks = written(rows.mapInArrow(_block_batches(BLOCK), BLOCKS), "suffix-blocks", compression="none")
    exchanged = blocks.mapInArrow(_name_batches(bits, low), "block long, range int, names binary, many binary")
    flags = exchanged.groupBy("range").applyInPandas(_repeated_names(HOT_BLOCKS), "block long, range int, flags binary, size int, n int")
    flags = written(flags, "suffix-flags", compression="none")
    left = flags.agg(F.sum("n")).first()[0] or 0
    range_bits = max(1, math.ceil(math.log2(1 + left * (BEFORE + LENGTH) / SUFFIX_BYTES)))
    by_block = flags.groupBy("block").agg(F.collect_list(F.struct("range", "flags", "size")).alias("flags"), F.sum("n").alias("n")).filter("n > 0")
    both = blocks.join(_small(by_block, F.aggregate("flags", F.lit(0), lambda a, f: a + F.octet_length(f["flags"]) + 16)), "block").select("keys", "lengths", "data", "flags")
    counted = both.mapInArrow(_count_ranges(bits, low, range_bits), "range int, n long").groupBy("range").agg(F.sum("n").alias("n"))
    full = np.zeros(1 << range_bits, np.uint8)  # a bit for each range: 1 MB at 100 TB
    full[[r["range"] for r in counted.filter(F.col("n") * (BEFORE + LENGTH) > FULL * SUFFIX_BYTES).collect()]] = 1
    bucket_bits = max(1, math.ceil(math.log2(1 + left / BUCKET_NAMES)))
    return both.mapInArrow(_suffix_batches(bits, low, range_bits, bucket_bits, np.packbits(full).tobytes()), SUFFIXES), bucket_bits


def repeated_spans(rows: DataFrame) -> DataFrame:
    """doc_id, ``th`` (text hash) and ``spans`` (packed runs of starts of repeated strings), one row a document."""
    suffixes, bucket_bits = exchanged_suffixes(rows)
    runs = suffixes.groupBy("range").applyInPandas(_compare_suffixes(bucket_bits), RUNS)
    return written(runs.groupBy("bucket").applyInPandas(_unite_runs, "doc_id long, th long, spans binary"), "suffix-spans")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the ``kept`` bytes."""
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text")
    rows = docs.filter("doc_id IS NOT NULL")
    copies = whole_copies(rows)
    spans = repeated_spans(rows.join(_small(copies, F.lit(16)), ["doc_id", "th"], "left_anti"))
    nothing = F.lit(None).cast("binary")
    gone = spans.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", "th", nothing.alias("spans"), F.lit(True).alias("copy")))
    joined = docs.join(_small(gone, F.coalesce(F.octet_length("spans"), F.lit(0)) + 32), ["doc_id", "th"], "left")
    kept = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return joined.select("doc_id", "text", "spans", "copy").mapInArrow(_cut_batches, kept)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
