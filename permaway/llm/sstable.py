"""Token ids in sorted-string-table shards: a binary output with lookup by document id.

A shard holds documents in ascending key order:

* data blocks of about ``BLOCK`` bytes.  An entry is three varints (bytes shared
  with the previous key, further key bytes, value bytes), the key's rest and the
  value; every ``RESTART``-th key is whole, and the block ends with the offsets
  of those restart points and their number.  A block is compressed with zstd;
* a Bloom filter over the keys;
* a sparse index: for each block its last key, offset, sizes and entries;
* a fixed footer with the places of index and filter, the counts and a magic.

A key is 00 for a null id, else 01 and the id as eight big-endian bytes with the
sign flipped, so that bytes sort as ids do.  A value is the ids as little-endian
unsigned integers of 2 or 4 bytes (the footer says which).

Defined cases: null text is the end id alone; a null id sorts first; equal ids
stand next to each other, in the order of the input; empty input writes no
shard and reads as no rows.

Shards are ranges of ids and input rows, so a shard is bounded however often an id
repeats.  The manifest has the first and
last key of each shard: a lookup bisects shards, then blocks, then restart points.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permaway.llm.storage import arrow_batches, written
from permaway.llm.tokens import default_path, encoder
from permaway.llm.workers import serving
from permaway.paths import located, new_dir, opened

MAGIC = b"PWSST001"
FOOTER = struct.Struct("<QQQQQQI8s")
BLOCK = 64 << 10
RESTART = 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Documents of one shard, as long as that makes no more than so many shards: the driver holds a small row for each.
SHARD_DOCS, MOST_SHARDS = 8192, 50_000
#: Documents read back in one batch.
READ_DOCS = 10_000


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_hashes(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + k * b) % bits for k in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard to a binary stream; keys must come in ascending order."""

    def __init__(self, out, wide: bool):
        self.out, self.wide, self.at = out, wide, 0
        self.pack = zstandard.ZstdCompressor(level=1)
        self.index: list[tuple[bytes, int, int, int, int]] = []
        self.keys: list[bytes] = []
        self.tokens = 0
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.size, self.restarts, self.last, self.entries = [], 0, [], b"", 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit."""
        key = key_of(doc_id)
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.entries % RESTART == 0:
            self.restarts.append(self.size)
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        value = ids if self.wide else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.block.append(entry)
        self.size += len(entry)
        self.entries += 1
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids) // 4
        if self.size >= BLOCK:
            self._end_block()

    def _end_block(self) -> None:
        raw = b"".join(self.block) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        packed = self.pack.compress(raw)
        self.out.write(packed)
        self.index.append((self.last, self.at, len(packed), len(raw), self.entries))
        self.at += len(packed)
        self._fresh()

    def close(self) -> None:
        if self.entries:
            self._end_block()
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_bloom_hashes(key, bits)] = True
        bloom_raw = np.packbits(bloom, bitorder="little").tobytes()
        index_raw = b"".join(_varint(len(k)) + k + b"".join(map(_varint, rest)) for k, *rest in self.index)
        self.out.write(bloom_raw)
        self.out.write(index_raw)
        self.out.write(FOOTER.pack(self.at + len(bloom_raw), len(index_raw), self.at, len(bloom_raw), len(self.keys), self.tokens, 4 if self.wide else 2, MAGIC))


class Reader:
    """Opens a shard by its footer, index and filter; data blocks are read when they are needed."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        source.seek(end - FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, self.n_docs, self.n_tokens, self.width, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        source.seek(bloom_at)
        self.bloom = np.frombuffer(source.read(bloom_n), np.uint8)
        source.seek(index_at)
        raw, at, self.index = source.read(index_n), 0, []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            place = []
            for _ in range(4):
                v, at = _read_varint(raw, at)
                place.append(v)
            self.index.append((key, *place))
        self.lasts = [x[0] for x in self.index]
        self.unpack = zstandard.ZstdDecompressor()

    def _block(self, k: int) -> tuple[bytes, list[int], int]:
        _, at, packed, raw_n, _ = self.index[k]
        self.source.seek(at)
        raw = self.unpack.decompress(self.source.read(packed), max_output_size=raw_n)
        (n,) = struct.unpack_from("<I", raw, len(raw) - 4)
        end = len(raw) - 4 - 4 * n
        return raw, list(struct.unpack_from(f"<{n}I", raw, end)), end

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(raw, at)
            more, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + more]
            at += more
            yield key, raw[at : at + size]
            at += size

    def _ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, "<u4" if self.width == 4 else "<u2")

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[h >> 3] >> (h & 7) & 1 for h in _bloom_hashes(key_of(doc_id), 8 * len(self.bloom)))

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document, by the filter, the block index and the block's restart points."""
        if not self.may_hold(doc_id):
            return None
        key = key_of(doc_id)
        k = bisect_left(self.lasts, key)
        if k == len(self.lasts):
            return None
        raw, restarts, end = self._block(k)
        lo, hi = 0, len(restarts) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if next(self._entries(raw, restarts[mid], end))[0] < key:
                lo = mid
            else:
                hi = mid - 1
        for found, value in self._entries(raw, restarts[lo], end):
            if found >= key:
                return self._ids(value) if found == key else None
        return None

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            raw, _, end = self._block(k)
            for key, value in self._entries(raw, 0, end):
                yield id_of(key), self._ids(value)


def open_shard(path: str) -> Reader:
    at, inner = opened(path)
    return Reader(at.open_input_file(inner))


def _write(folder: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        at, inner = opened(folder)
        encode = encoder(vocabulary)
        wide = encode.whole.get_vocab_size() > 1 << 16
        out = None
        for batch in batches:
            if out is None and len(batch):
                at.create_dir(inner, recursive=True)
                name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}.sst"
                out = at.open_output_stream(f"{inner}/{name}")
                shard = Writer(out, wide)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard.add(doc_id, encode.encode(text))
        if out is not None:
            shard.close()
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([task.partitionId()], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([len(shard.keys)], pa.int64()), pa.array([shard.tokens], pa.int64()), pa.array([shard.keys[0]], pa.binary()), pa.array([shard.keys[-1]], pa.binary())],
                ["shard", "path", "n_docs", "n_tokens", "first", "last"],
            )

    return run


def write_shards(docs: DataFrame, folder: str, path: str | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Writes shards in ascending id order below ``folder``; the manifest names those of the tasks that succeeded.

    Manifest: shard, path, n_docs, n_tokens, first and last (keys), start (ids of all shards before).
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    folder = located(spark, folder)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id())
    shards = min(MOST_SHARDS, max(1, -(-docs.select("doc_id").count() // shard_docs)))
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "row")]
    ordered = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = written(ordered.mapInArrow(serving("tokens", _write(folder, path or default_path())), "shard long, path string, n_docs long, n_tokens long, first binary, last binary"), "manifest")
    # one small row per shard, MOST_SHARDS at most: the driver adds up where each begins
    rows, start = [], 0
    for r in manifest.orderBy("shard").toLocalIterator():
        rows.append((*r, start))
        start += r.n_tokens
    return spark.createDataFrame(rows, "shard long, path string, n_docs long, n_tokens long, first binary, last binary, start long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = iter(open_shard(path))
            while rows := list(islice(shard, READ_DOCS)):
                sizes = [len(ids) for _, ids in rows]
                starts = start + np.cumsum([0, *sizes])
                start = int(starts[-1])
                columns = ([d for d, _ in rows], starts[:-1], sizes, [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in rows])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: its first id's place in the whole output, its ids and their crc."""
    n = max(1, manifest.count())
    return manifest.select("path", "start").repartition(n).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, manifest: DataFrame, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of a few documents: only shards whose keys can hold one are opened; of equal ids the first counts."""
    shards = sorted((bytes(r.first), bytes(r.last), r.path) for r in manifest.select("first", "last", "path").collect())  # MOST_SHARDS at most
    lasts, readers, found = [last for _, last, _ in shards], {}, {}
    for doc_id in doc_ids:
        key = key_of(doc_id)
        for first, _, path in islice(shards, bisect_left(lasts, key), None):
            if first > key:
                break
            if path not in readers:
                readers[path] = open_shard(path)
            if (ids := readers[path].get(doc_id)) is not None:
                found[doc_id] = ids
                break
    return found


def round_trip(docs: DataFrame, path: str | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Writes all documents and reads them back."""
    return read_shards(write_shards(docs, new_dir(docs.sparkSession, "shards"), path, shard_docs))
