"""ZIP archives of (file_name, content) rows, written by the tasks of a Python data sink."""

from __future__ import annotations

import codecs
import functools
import hashlib
import io
import itertools
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from permaway.paths import files_of, located, opened
from permaway.shipping import ship


@dataclass
class _Done(WriterCommitMessage):
    paths: list[str]
    found: list = field(default_factory=list)


def zipped(entries: list[tuple[str, str | bytes]], level: int = 9) -> bytes:
    """An archive; of equal names the last counts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as z:
        for name, content in dict(entries).items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED, level)
    return out.getvalue()


# ---- the format, for archives that no task holds as a whole: compressed pieces that lie one behind the other are one entry


#: The last block of an entry, and bytes that are read at once.
LAST, READ = b"\x03\x00", 4 << 20
_FULL, _MANY, _DATE = 0xFFFFFFFF, 0xFFFF, 33


class Piece(NamedTuple):
    """Compressed bytes without an end, and the checksum and number of the plain ones."""

    data: bytes
    crc: int
    size: int


def deflated(texts: Iterable[str | bytes], level: int) -> Piece:
    packer, parts, crc, size = zlib.compressobj(level, zlib.DEFLATED, -15), [], 0, 0
    for text in texts:
        plain = text.encode() if isinstance(text, str) else text
        parts.append(packer.compress(plain))
        crc, size = zlib.crc32(plain, crc), size + len(plain)
    return Piece(b"".join([*parts, packer.flush(zlib.Z_FULL_FLUSH)]), crc, size)


def _product(a: int, b: int) -> int:
    """Of two polynomials modulo that of the checksum, the lowest power in the highest bit; ``a`` is not 0."""
    m, p = 1 << 31, 0
    while True:
        if a & m:
            p ^= b
            if not a & (m - 1):
                return p
        m >>= 1
        b = (b >> 1) ^ 0xEDB88320 if b & 1 else b >> 1


_SQUARES = [1 << 30]
while len(_SQUARES) < 32:
    _SQUARES.append(_product(_SQUARES[-1], _SQUARES[-1]))


def joined_crc(first: int, second: int, size: int) -> int:
    """The checksum of two texts, one behind the other; ``size``: bytes of the second."""
    power, k = 1 << 31, 3
    while size:
        if size & 1:
            power = _product(_SQUARES[k & 31], power)
        size, k = size >> 1, k + 1
    return _product(power, first) ^ second


class Entry(NamedTuple):
    name: str
    crc: int
    packed: int
    size: int
    at: int = 0

    def record(self, last: bool) -> bytes:
        """What stands before the entry's bytes, or its record at the archive's end."""
        name = self.name.encode()
        large = max(self.packed, self.size, self.at) >= _FULL
        more = struct.pack("<2H2Q", 1, 24 if last else 16, self.size, self.packed) + (struct.pack("<Q", self.at) if last else b"") if large else b""
        need, packed, size, at = (45, _FULL, _FULL, _FULL) if large else (20, self.packed, self.size, self.at)
        common = (need, 0x800, zipfile.ZIP_DEFLATED, 0, _DATE, self.crc, packed, size, len(name), len(more))
        if last:
            return struct.pack("<4s6H3L5H2L", b"PK\1\2", 3 << 8 | need, *common, 0, 0, 0, 0o600 << 16, at) + name + more
        return struct.pack("<4s5H3L2H", b"PK\3\4", *common) + name + more


def _end(entries: list[Entry], at: int) -> bytes:
    """The records at the archive's end, which stand at ``at``; of equal names the last counts."""
    records = [e.record(True) for e in {e.name: e for e in entries}.values()]
    n, size = len(records), sum(map(len, records))
    if n >= _MANY or at + size >= _FULL:
        records.append(struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, at) + struct.pack("<4sLQL", b"PK\6\7", 0, at + size, 1))
    return b"".join([*records, struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, min(n, _MANY), min(n, _MANY), min(size, _FULL), min(at, _FULL), 0)])


def _copied(store, path: str, out, at: int = 0, size: int | None = None) -> None:
    with store.open_input_file(path) as stream:
        stream.seek(at)
        while (size is None or size > 0) and (data := stream.read(READ if size is None else min(READ, size))):
            out.write(data)
            size = size and size - len(data)


class _Writer(DataSourceWriter):
    """Every task writes its entries under a temporary name; a commit puts them one behind the other, or moves them into place."""

    def __init__(self, options: dict):
        self.path, self.level, self.single = options["path"], int(options.get("level", 9)), options.get("single", "true") == "true"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        first = next(rows := iter(rows), None)
        if first is None:
            return _Done([])
        store, inner = opened(self.path)
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        task = TaskContext.get()
        part = f"{inner}.part-{task.partitionId():05d}-{task.taskAttemptId()}"
        try:
            with store.open_output_stream(part) as out:
                return _Done([part], self.filled(out, itertools.chain([first], rows)))
        except BaseException:
            store.delete_file(part)
            raise

    def filled(self, out, rows: Iterator) -> list:
        """The entries of a task's file; without ``single`` it is an archive."""
        entries = []
        for row in rows:
            made = row[1] if isinstance(row[1], list) else [deflated([row[1]], self.level)]
            crc = functools.reduce(lambda crc, p: joined_crc(crc, p[1], p[2]), made, 0)
            entry = Entry(row[0], crc, sum(len(p[0]) for p in made) + len(LAST), sum(p[2] for p in made), out.tell())
            entries.append(entry)
            out.write(entry.record(False))
            for p in made:
                out.write(p[0])
            out.write(LAST)
        if not self.single:
            out.write(_end(entries, out.tell()))
        return entries

    def commit(self, messages: list) -> None:
        store, inner = opened(self.path)
        parts = [(m.paths[0], m.found) for m in messages if m and m.paths]
        if self.single and parts:
            with store.open_output_stream(f"{inner}.whole") as out:
                self.merged(store, parts, out)
            store.move(f"{inner}.whole", inner)
        elif len(parts) == 1:
            store.move(parts[0][0], inner)
        else:
            stem, _, suffix = inner.rpartition(".")
            for k, (p, _) in enumerate(parts):
                store.move(p, f"{stem}-{k:05d}.{suffix}")

    def merged(self, store, parts: list, out) -> None:
        entries = []
        for part, found in parts:
            entries += [e._replace(at=e.at + out.tell()) for e in found]
            _copied(store, part, out)
            store.delete_file(part)
        out.write(_end(entries, out.tell()))

    def abort(self, messages: list) -> None:
        store, _ = opened(self.path)
        for m in messages:
            for p in m.paths if m else []:
                store.delete_file(p)


class _EntryWriter(_Writer):
    """One entry of many rows (bucket, place, content): tasks write buckets, a commit puts them in order."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.name = options["entry"]

    def filled(self, out, rows: Iterator) -> list:
        found = []
        for bucket, inner in itertools.groupby(rows, lambda r: r[0]):
            piece = deflated((r[2] for r in inner), self.level)
            found.append((bucket, out.tell(), len(piece.data), piece.crc, piece.size))
            out.write(piece.data)
        return found

    def merged(self, store, parts: list, out) -> None:
        pieces = sorted((*f, part) for part, found in parts for f in found)
        crc = functools.reduce(lambda crc, p: joined_crc(crc, p[3], p[4]), pieces, 0)
        entry = Entry(self.name, crc, sum(p[2] for p in pieces) + len(LAST), sum(p[4] for p in pieces))
        out.write(entry.record(False))
        for _, at, size, _, _, part in pieces:
            _copied(store, part, out, at, size)
        out.write(LAST)
        out.write(_end([entry], out.tell()))
        for part, _ in parts:
            store.delete_file(part)


class ArchiveSink(DataSource):
    """Options ``path``, ``level``, and ``single`` (else each partition makes an archive); columns file_name and content.

    ``content`` is text, bytes, or the entry's pieces.  With the option ``entry`` the columns are bucket, place
    and content: the texts of one entry of that name, each bucket in one partition and in order.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return (_EntryWriter if "entry" in self.options else _Writer)(dict(self.options))


def _saved(rows: DataFrame, path: str, **options) -> None:
    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(ArchiveSink)
    rows.write.format("archive").options(**options).option("path", located(rows.sparkSession, path)).mode("append").save()


def write_archive(files: DataFrame, path: str, single: bool = True, level: int = 9) -> None:
    """Writes the rows as one archive, or as one per partition; every partition packs its own rows, one at a time."""
    _saved(files.select("file_name", "content"), path, level=level, single=single)


#: Tasks that the texts of one entry are dealt to, at least.
TASKS = 200


def write_entry(pieces: DataFrame, name: str, path: str, level: int = 9) -> None:
    """Writes texts (bucket, place, content) as the one entry of an archive, ordered by bucket and place; no task holds more than some buckets."""
    tasks = max(TASKS, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    _saved(pieces.select("bucket", "place", "content").repartition(tasks, "bucket").sortWithinPartitions("bucket", "place"), path, level=level, entry=name)


class _FileWriter(DataSourceWriter):
    """Every row becomes a file below the folder; a repeated attempt writes the same files again."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, folder = opened(self.path)
        store.create_dir(folder, recursive=True)
        attempt, done = TaskContext.get().taskAttemptId(), []
        for name, content in ((r[0], r[1]) for r in rows):
            part = f"{folder}/.{name}.part-{attempt}"
            with store.open_output_stream(part) as out:
                out.write(content.encode() if isinstance(content, str) else content)
            store.move(part, f"{folder}/{name}")
            done.append(f"{folder}/{name}")
        return _Done(done[:1])

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        pass


class FileSink(DataSource):
    """Option ``path``, a folder; columns file_name and content."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(dict(self.options))


def write_files(files: DataFrame, folder: str) -> None:
    """Writes each row (file_name, content) as a file of that name below ``folder``."""
    ship(files.sparkSession)
    files.sparkSession.dataSource.register(FileSink)
    files.select("file_name", "content").write.format("named_files").option("path", located(files.sparkSession, folder)).mode("append").save()


def _plain(stream, at: int, packed: int, crc: int, method: int) -> Iterator[bytes]:
    """The plain bytes of an entry, some megabytes at a time."""
    stream.seek(at)
    head = stream.read(30)
    stream.seek(at + 30 + sum(struct.unpack("<2H", head[26:])))
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise NotImplementedError(f"compression method {method}")
    unpacker = zlib.decompressobj(-15) if method else None
    got = 0
    while packed:
        data = stream.read(min(READ, packed))
        if not data:
            raise zipfile.BadZipFile("an entry ends too early")
        packed -= len(data)
        while data:
            plain, data = (unpacker.decompress(data, READ), unpacker.unconsumed_tail) if unpacker else (data, b"")
            got = zlib.crc32(plain, got)
            yield plain
    if unpacker:
        rest = unpacker.flush()
        got = zlib.crc32(rest, got)
        yield rest
    if got != crc:
        raise zipfile.BadZipFile("an entry's checksum is wrong")


def _text(name: str, pieces: Iterator[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"file_name": [name], "content": [b"".join(pieces).decode()]})


def _digest(name: str, pieces: Iterator[bytes]) -> pa.RecordBatch:
    digest, read, n = hashlib.md5(), codecs.getincrementaldecoder("utf-8")(), 0
    for p in pieces:
        digest.update(p)
        n += len(read.decode(p))
    n += len(read.decode(b"", True))
    return pa.RecordBatch.from_pydict({"file_name": [name], "content_md5": [digest.hexdigest()], "n_chars": [n]})


#: Plain bytes of the entries that one row of the list of entries names, unless a single one has more.
ROW = 4 << 20


def _entries(spark: SparkSession, paths: list[str], made, schema: str) -> DataFrame:
    """A row of ``schema`` for each entry: one task lists an archive, many read their share of the entries."""
    types = pa.struct([("name", pa.string()), *((c, pa.int64()) for c in ("at", "packed", "crc", "method"))])

    def listed(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = opened(path)
                with store.open_input_file(inner) as stream, zipfile.ZipFile(stream) as z:
                    every, before = z.infolist(), 0
                    shares: dict[int, list] = {}
                    for e in every:
                        shares.setdefault(before // ROW, []).append((e.filename, e.header_offset, e.compress_size, e.CRC, e.compress_type))
                        before += e.file_size
                for share in shares.values():
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([[dict(zip(types.names, e, strict=True)) for e in share]], pa.list_(types))], ["path", "entries"])

    def run(batches):
        for batch in batches:
            for path, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inner = opened(path)
                with store.open_input_file(inner) as stream:
                    for e in entries:
                        yield made(e.pop("name"), _plain(stream, **e))

    ship(spark)
    at = spark.createDataFrame([(p,) for p in files_of(spark, paths)], "path string").repartition(max(1, len(paths)))
    shares = at.mapInArrow(listed, "path string, entries array<struct<name: string, at: bigint, packed: bigint, crc: bigint, method: bigint>>")
    return shares.repartition(max(len(paths), int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(run, schema)


def read_archives(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_name, content) of the text entries of archives."""
    return _entries(spark, paths, _text, "file_name string, content string")


def read_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_name, content_md5, n_chars) of the text entries of archives, whatever their size: they are read piece by piece."""
    return _entries(spark, paths, _digest, "file_name string, content_md5 string, n_chars bigint")
