"""Best-fit packing of documents into sequences by hierarchical residual packing.

Each task encodes its documents, packs their pieces best-fit (longest first)
into bins of ``capacity`` tokens, and writes what it placed.  Bins that are full,
or that no other underfull bin fits, are final; the underfull ones become items
of the next round, gathered into fewer groups each round, until one group is
left.  Two bins over half full never fit together, and each of the others goes
into one bin at most; so of the bins of one load no more take part than there are
bins of half the capacity or less, which leaves the result as it is.

A document is its ids and the end id.  Only a document longer than the capacity
is cut, into pieces of full capacity; its first piece may be shorter.  Defined
cases: null text is the end id alone; repeated rows are packed each; empty input
gives no row; ties go to the fuller bin, then to the bin opened first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from permaway.llm.storage import arrow_batches, written
from permaway.llm.tokens import default_path, encoder
from permaway.llm.workers import serving

CAPACITY = 2048
#: Pieces that one local round sorts and packs together.
LOCAL = 20_000
#: Underfull bins of one group in a later round.
GROUP = 20_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins: best-fit with the longest items first."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_by_rest: list[list[int]] = [[] for _ in range(capacity + 1)]
    rests, count = 0, 0  # bit r of rests: some bin has r tokens left
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        fits = rests >> size
        if fits:
            rest = size + (fits & -fits).bit_length() - 1
            held = open_by_rest[rest]
            bin_ = held.pop()
            if not held:
                rests &= ~(1 << rest)
        else:
            rest, bin_, count = capacity, count, count + 1
        bins[k], offsets[k] = bin_, capacity - rest
        rest -= size
        if rest:
            open_by_rest[rest].append(bin_)
            rests |= 1 << rest
    return bins, offsets, count


def _place(path: str, capacity: int):
    def flush(rows: list[tuple], opened: int) -> tuple[pa.RecordBatch, int]:
        columns = list(zip(*rows, strict=True))
        bins, offsets, count = best_fit(np.array(columns[3]), capacity)
        base = (TaskContext.get().partitionId() << 40) + opened
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(bins + base), pa.array(offsets)], ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset"]), opened + count

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows, opened = encoder(path).encode, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text)
                n = len(ids) // 4
                first = n % capacity or capacity
                start, end = 0, min(first, n)
                piece = 0
                while start < n:
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                    piece, start, end = piece + 1, end, end + capacity
            if len(rows) >= LOCAL:
                out, opened = flush(rows, opened)
                yield out
                rows = []
        if rows:
            yield flush(rows, opened)[0]

    return run


def _merge(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        loads = table.column("load").to_numpy()
        bins, offsets, count = best_fit(loads, capacity)
        heads = np.zeros(count, np.int64)
        ids = table.column("bin").to_numpy()
        at_start = offsets == 0
        heads[bins[at_start]] = ids[at_start]
        return pa.table({"bin": ids, "into": heads[bins], "base": offsets})

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece: its document, place in the document, crc of its ids, sequence and offset there."""
    spark = docs.sparkSession
    arrow_batches(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(narrow.mapInArrow(serving("tokens", _place(path or default_path(), capacity)), PIECES), "pieces")
    under = pieces.groupBy("bin").agg(F.sum("length").alias("load")).where(F.col("load") < capacity)
    under = written(under.select("bin", "load", F.col("bin").alias("into"), F.lit(0).cast("long").alias("base"), F.lit(0).alias("level")), "underfull")
    moves, level, groups = under.drop("load", "level"), 0, None
    while True:
        # what no other underfull bin fits into is final
        least, small = under.agg(F.min("load"), F.count(F.when(2 * F.col("load") <= capacity, 1))).first()
        if not small:
            break
        rank = F.row_number().over(Window.partitionBy("load").orderBy("bin"))
        live = written(under.where(F.col("load") + least <= capacity).withColumn("rank", rank).where(F.col("rank") <= small).drop("rank"), "live")
        n = live.count()
        if n < 2:
            break
        most = -(-n // GROUP)
        groups = most if groups is None else min(most, max(1, groups // 2))
        keyed = live.select("bin", "load", F.pmod(F.hash("bin", F.lit(level)), F.lit(groups)).alias("g"))
        step = written(keyed.groupBy("g").applyInArrow(_merge(capacity), "bin long, into long, base long"), "merged")
        loads = live.select("bin", "load").join(step, "bin").groupBy(F.col("into").alias("bin")).agg(F.sum("load").alias("load"))
        under = written(loads.where(F.col("load") < capacity), "underfull")
        s = step.select(F.col("bin").alias("_b"), F.col("into").alias("_i"), F.col("base").alias("_o"))
        moves = written(moves.join(s, moves["into"] == s["_b"], "left").select("bin", F.coalesce("_i", "into").alias("into"), (F.col("base") + F.coalesce("_o", F.lit(0))).alias("base")), "moves")
        level += 1
        if groups == 1:
            break
    m = moves.where("bin != into").select(F.col("bin").alias("_b"), "into", "base")
    return pieces.join(m, pieces["bin"] == m["_b"], "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset")
    )
