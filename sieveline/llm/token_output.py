"""Token-ID output with a shared zstandard dictionary (operator 4).

Texts are encoded, an end id is appended, and each document's ids (little-endian uint32) become one
zstandard frame of its own, compressed with a dictionary that is trained on the id arrays of a
bounded sample. Documents lie in ascending ``doc_id`` order over range partitions.

File format: a Parquet table of shards. A shard is at most about ``SHARD_BYTES`` of frames laid end
to end in ``data``, with an offset index (``doc_id``, ``offset``, ``length``, ``n_tokens`` for each
document), the SHA-256 of the dictionary, its range partition ``part`` and ``start``, the ids before
it in that partition. One short document is read by finding its shard from ``first_doc``/``last_doc``
(Parquet statistics prune the rest), slicing ``data`` and decompressing one frame.

Encoding works on pieces between single spaces: a byte-level pre-token never spans such a place, so
each distinct piece is encoded once for each worker and looked up afterwards; unknown ones are
encoded many to a text. Pieces around other white space stay together. Special tokens of the file count where their strings stand in a text.

Edge cases: a null or empty text has only the end id; rows that repeat a ``doc_id`` are all written,
in any order among themselves; null ``doc_id`` come first; an empty table writes an empty shard
table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
SHARD_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCUMENTS = 512
SAMPLE_BYTES = 1 << 16
LEVEL = 3
CACHE_PIECES = 1_000_000
#: white space other than blank and line feed
UNUSUAL_SPACE = re.compile(r"[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: the byte of a space in a byte-level vocabulary
SPACE = "\u0120"
JOINED_PIECES = 128

INDEX = "array<struct<doc_id:bigint,offset:bigint,length:int,n_tokens:int>>"
SHARDS = f"part int, start long, n_tokens long, first_doc long, last_doc long, dictionary_sha256 string, index {INDEX}, data binary"


class Encoder:
    """Text to the bytes of its ids, with a bounded cache of pieces."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = array("I", [end_id]).tobytes()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.first: dict[str, bytes] = {}  # pieces at the start of a text
        self.former: dict[str, bytes] = {}
        self.cache: dict[str, bytes] = {}  # pieces behind a space, which the key leaves out

    @staticmethod
    def is_plain(text: str) -> bool:
        """All single spaces of the text stand between other characters than white space, and there is no other one than line feeds."""
        return not (text[:1] in ("", " ") or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or UNUSUAL_SPACE.search(text))

    @staticmethod
    def pieces(text: str) -> list[str]:
        """Parts of a text that isn't plain that pre-tokenise on their own; joined by single spaces they are the text."""
        split = text.split(" ")
        out = [split[0]]
        for before, piece in zip(split, split[1:], strict=False):
            if piece and before and not piece[0].isspace() and not before[-1].isspace():
                out.append(piece)
            else:
                out[-1] += " " + piece
        return out

    def _encode_into(self, cache: dict[str, bytes], unseen: list[str], before: str) -> None:
        for i in range(0, len(unseen), 4096):
            some = unseen[i : i + 4096]
            encoded = self.tokenizer.encode_batch_fast([before + p for p in some], add_special_tokens=False)
            for piece, made in zip(some, encoded, strict=True):
                cache[piece] = array("I", made.ids).tobytes()

    def _encode_joined(self, unseen: list[str]) -> None:
        """Pieces behind a space, many in one text: of their ids only the first one of each begins with a space."""
        for i in range(0, len(unseen), JOINED_PIECES):
            some = unseen[i : i + JOINED_PIECES]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.spaced[ids])
            if len(at) != len(some) or at[0]:  # not seen with this tokenizer; another may have tokens over a space
                self._encode_into(self.cache, some, " ")
                continue
            raw, at = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            self.cache.update(zip(some, [raw[b:e] for b, e in zip(at, at[1:], strict=False)], strict=True))

    def _learn(self, heads: list[str], later: list[str]) -> None:
        """Encodes pieces that no cache holds, each of them once."""
        self._encode_into(self.first, heads, "")
        joined = [p for p in later if " " not in p and not p[0].isspace() and not p[-1].isspace()]
        self._encode_joined(joined)
        if len(joined) < len(later):
            self._encode_into(self.cache, [p for p in later if p not in self.cache], " ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id. Distinct pieces are looked up; those not yet known are encoded together.

        A full cache becomes the former one, from which pieces that occur again come back: rare ones go.
        """
        if not texts:
            return []
        if len(self.cache) + len(self.first) > CACHE_PIECES // 2:
            self.former, self.cache, self.first = self.cache, {}, {}
        is_plain = list(map(self.is_plain, texts))
        order = sorted(range(len(texts)), key=lambda i: not is_plain[i])
        n_plain = sum(is_plain)
        plain = pc.split_pattern(pa.array([texts[i] for i in order[:n_plain]], pa.string()), " ")
        others = [self.pieces(texts[i]) for i in order[n_plain:]]
        flat = pa.concat_arrays([plain.flatten(), pa.array([p for ps in others for p in ps], pa.string())])
        counts = np.concatenate([plain.value_lengths().to_numpy(zero_copy_only=False), np.fromiter(map(len, others), np.int64, len(others))]).astype(np.int64)
        begin = np.cumsum(counts) - counts
        heads = flat.take(pa.array(begin)).to_pylist()  # no space is before these
        later = np.ones(len(flat), bool)
        later[begin] = False
        coded = flat.filter(pa.array(later)).dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.cache.get, pieces))
        unseen = [p for p, x in zip(pieces, found, strict=True) if x is None]
        if unseen and self.former:
            self.cache.update((p, self.former[p]) for p in unseen if p in self.former)
            unseen = [p for p in unseen if p not in self.former]
        self._learn(list({h for h in heads if h not in self.first}), unseen)
        table = [*map(self.cache.__getitem__, pieces), *map(self.first.__getitem__, heads), self.end]
        # each text: its head, its later pieces, the end
        texts_before = np.arange(len(texts))
        codes = np.full(len(flat) + len(texts), -1, np.int64)
        codes[begin + texts_before] = len(pieces) + texts_before
        codes[begin + counts + texts_before] = len(table) - 1
        codes[codes < 0] = coded.indices.to_numpy(zero_copy_only=False)
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        start, own = (np.cumsum(size) - size)[codes], size[codes]
        ends = np.cumsum(own)
        raw = np.frombuffer(b"".join(table), "<u4")[np.repeat(start - ends + own, own) + np.arange(int(own.sum()))].tobytes()
        stops = (4 * ends[begin + counts + texts_before]).tolist()
        out = [b""] * len(texts)
        for i, low, high in zip(order, [0, *stops], stops, strict=False):
            out[i] = raw[low:high]
        return out


@lru_cache(maxsize=2)
def _encoder(path: str, end_id: int) -> Encoder:
    """One for each Python worker, kept over tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, end_id)


def _batches(texts: list[str], most: int = 1 << 21) -> Iterator[slice]:
    """Slices of about ``most`` characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def train_dictionary(docs: DataFrame, path: str = TOKENIZER, end_id: int = END_ID, sample: int = SAMPLE_DOCUMENTS) -> bytes:
    """A dictionary from the id arrays of about ``sample`` documents, chosen by hashed ``doc_id``.

    Of each at most the first ``SAMPLE_BYTES`` of ids come to the driver. Too little to train on gives
    an empty dictionary. The sample only shapes compression: all documents are written whole.
    """
    n = docs.count()
    step = max(1, n // sample)
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).limit(2 * sample).select("text")

    def ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"ids": [x[:SAMPLE_BYTES] for x in _encoder(path, end_id).encode(frame["text"].fillna("").tolist())]})

    arrays = [bytes(r.ids) for r in some.mapInPandas(ids, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


def _shards(dictionary: bytes, path: str, end_id: int, shard_bytes: int):
    digest = hashlib.sha256(dictionary).hexdigest()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).compress
        index: list[dict] = []
        frames: list[bytes] = []
        size = start = 0

        def shard() -> pa.RecordBatch:
            n = sum(e["n_tokens"] for e in index)
            row = {"part": part, "start": start, "n_tokens": n, "first_doc": index[0]["doc_id"], "last_doc": index[-1]["doc_id"],
                   "dictionary_sha256": digest, "index": index, "data": b"".join(frames)}
            return pa.RecordBatch.from_pylist([row], _arrow_schema())

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for s in _batches(texts):
                for doc_id, raw in zip(ids[s], _encoder(path, end_id).encode(texts[s]), strict=True):
                    frame = compress(raw)
                    index.append({"doc_id": doc_id, "offset": size, "length": len(frame), "n_tokens": len(raw) // 4})
                    frames.append(frame)
                    size += len(frame)
                    if size >= shard_bytes:
                        made = shard()
                        yield made
                        start += made.column("n_tokens")[0].as_py()
                        index, frames, size = [], [], 0
        if index:
            yield shard()

    return write


def _arrow_schema() -> pa.Schema:
    entry = pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int32()), ("n_tokens", pa.int32())])
    return pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
                      ("dictionary_sha256", pa.string()), ("index", pa.list_(entry)), ("data", pa.binary())])


def write_tokens(docs: DataFrame, out: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes ``out/dictionary`` (one row) and ``out/shards``, documents in ascending ``doc_id`` order."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    dictionary = train_dictionary(docs, tokenizer, end_id)
    row = [(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))]
    spark.createDataFrame(row, "dictionary_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{out}/dictionary")
    ranged = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    shards = ranged.mapInArrow(_shards(dictionary, tokenizer, end_id, shard_bytes), SHARDS)
    shards.write.option("compression", "none").parquet(f"{out}/shards")


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """One row per document: doc_id, ``start`` (ids of all documents before it) and ``ids`` (their bytes)."""
    dictionary_row = spark.read.parquet(f"{out}/dictionary").first()  # one row of at most DICTIONARY_BYTES
    dictionary, expected = bytes(dictionary_row["dictionary"]), dictionary_row["dictionary_sha256"]
    if hashlib.sha256(dictionary).hexdigest() != expected:
        raise ValueError("the dictionary doesn't have its digest")
    shards = spark.read.parquet(f"{out}/shards")
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row per range partition
    bases, base = [], 0
    for r in totals:
        bases.append((r["part"], base))
        base += r["n"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).decompress
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != expected:
                    raise ValueError("a shard was written with another dictionary")
                at, size, rows = row["start"] + row["base"], 0, []
                for e in row["index"]:
                    raw = decompress(row["data"][e["offset"] : e["offset"] + e["length"]])
                    rows.append((e["doc_id"], at, e["n_tokens"], raw))
                    at += e["n_tokens"]
                    size += len(raw)
                    if size > 16 << 20:
                        yield _unpacked(rows)
                        size, rows = 0, []
                if rows:
                    yield _unpacked(rows)

    placed = shards.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part")  # one row per range partition
    return placed.select("start", "base", "dictionary_sha256", "index", "data").mapInArrow(
        unpack, "doc_id long, start long, n_tokens long, ids binary"
    )


def _unpacked(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])


def token_digests(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, from the files."""
    return read_tokens(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), out)
    return token_digests(spark, out)


QUERIES = {"op4_token_output": op4_token_output}
ORACLE_SQL: dict[str, str] = {}
