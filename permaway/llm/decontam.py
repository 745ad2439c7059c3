"""Benchmark decontamination with an FM-index per shard of training documents.

Each task reads its documents as words, keeps the stretches that could hold a
benchmark window, and builds one FM-index per shard over them: a suffix array,
its Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions.
All windows are searched backward at once; occurrences are located by walking
to sampled positions and merged into removal spans.

Words are runs of bytes outside ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F`` after A-Z
are lower-cased.  A window is ``window`` consecutive words of an item, or all
words of a shorter item.  Defined cases: a null or wordless text has no words
and no hits; an item without words has no window; an item with a null id counts
under the empty id; equal item ids count as one item; repeated documents are
each reported; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permaway.llm.arrays import IntMap, Words, utf8
from permaway.llm.storage import arrow_batches, written
from permaway.llm.workers import serving

#: Bytes that separate words (after folding); all others belong to words.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
WORDS = Words(SEPARATORS)

#: Benchmark text per block: what is sent to the executors at once. A larger benchmark is searched in several blocks.
BLOCK_BYTES = 8 << 20
#: Words per FM-index.
SHARD_WORDS = 1 << 18
#: Text that one task holds back until its index is searched.
HELD_BYTES = 8 << 20
#: Every so many suffix positions are stored.
SAMPLE = 8

RESULT = "doc_id long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"


class WaveletMatrix:
    """Rank of any symbol in a sequence, by one bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.levels = len(symbols), []
        for level in range(bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            packed = np.packbits(np.pad(bit, (0, -self.n % 64 + 64)), bitorder="little").view(np.uint64)
            before = np.zeros(len(packed) + 1, np.int64)
            np.cumsum(np.bitwise_count(packed), out=before[1:])
            zeros = self.n - int(bit.sum())
            self.levels.append((level, packed, before, zeros))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << rest) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position ``at``."""
        lo = np.zeros_like(at)
        for level, packed, before, zeros in self.levels:
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self._ones(packed, before, lo), self._ones(packed, before, at)
            lo, at = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, at - b)
        return at - lo


def suffix_array(first: np.ndarray) -> np.ndarray:
    """Positions sorted by suffix; only the ranges still tied are sorted again, at doubled depth."""
    n = len(first)
    order = np.argsort(first, kind="stable")
    key = first[order]
    starts = np.concatenate([[True], key[1:] != key[:-1]])
    head = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    depth = 1
    while True:
        size_one = starts & np.concatenate([starts[1:], [True]])
        tied = np.flatnonzero(~size_one)
        if not len(tied):
            return order
        pos = order[tied]
        nxt = pos + depth
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1)
        by = np.lexsort((second, head[tied]))
        order[tied] = pos[by]
        second = second[by]
        h = head[tied]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (second[1:] != second[:-1])])
        starts[tied] = new
        head[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        rank[order[tied]] = head[tied]
        depth *= 2


class FMIndex:
    """Backward search over stretches of symbols 1..alphabet; each stretch ends with the separator 0."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = SAMPLE):
        n = len(text)
        breaks = np.flatnonzero(text == 0)
        distinct = text.astype(np.int64) + len(breaks)
        distinct[breaks] = np.arange(len(breaks))  # no two separators are equal: ties end with a stretch
        order = suffix_array(distinct)
        before = text[order - 1]
        begins = (order == 0) | (before == 0)
        self.last = np.where(begins, 0, before).astype(np.int64)
        self.tree = WaveletMatrix(self.last, max(1, int(alphabet).bit_length()))
        counts = np.bincount(text, minlength=alphabet + 2)
        self.below = np.concatenate([[0], np.cumsum(counts)])
        self.kept = begins | (order % sample == 0)
        self.place = np.where(self.kept, order, -1)
        self.n = n

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For right-aligned pattern rows: the range of suffixes that begin with each pattern."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(patterns.shape[1]):
            live = np.flatnonzero((lengths > step) & (lo < hi))
            if not len(live):
                break
            c = patterns[live, patterns.shape[1] - 1 - step]
            lo[live] = self.below[c] + self.tree.rank(c, lo[live])
            hi[live] = self.below[c] + self.tree.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffix rows, by steps back to sampled positions."""
        out, steps, rows = np.empty(len(rows), np.int64), 0, rows.copy()
        left = np.arange(len(rows))
        while len(left):
            kept = self.kept[rows]
            out[left[kept]] = self.place[rows[kept]] + steps
            left, rows = left[~kept], rows[~kept]
            c = self.last[rows]
            rows = self.below[c] + self.tree.rank(c, rows)
            steps += 1
        return out


class Windows:
    """The windows of one block of benchmark items, as rows of word numbers."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = sorted({name for name, _ in items})
        at = {name: k for k, name in enumerate(self.names)}
        hashes, firsts = WORDS.hashes(*utf8(pa.array([text for _, text in items], pa.large_string())))
        self.vocabulary = np.unique(hashes)
        numbers = np.searchsorted(self.vocabulary, hashes) + 1
        owners: dict[bytes, set[int]] = {}
        for (name, _), a, b in zip(items, firsts[:-1], firsts[1:], strict=True):
            for k in range(a, max(a + 1, b - window + 1) if b > a else a):
                owners.setdefault(numbers[k : min(k + window, b)].tobytes(), set()).add(at[name])
        rows = [np.frombuffer(k, numbers.dtype) for k in owners]
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.rows = np.zeros((len(rows), window), np.int64)
        for k, r in enumerate(rows):
            self.rows[k, window - len(r) :] = r
        self.owner = np.array([x for v in owners.values() for x in sorted(v)], np.int64)
        self.owner_at = np.concatenate([[0], np.cumsum([len(v) for v in owners.values()])]).astype(np.int64)
        self.window = window
        short = self.lengths < window
        self.short_words = np.unique(np.concatenate([r for r, s in zip(rows, short, strict=True) if s] or [np.zeros(0, np.int64)]))
        self.short_least = int(self.lengths[short].min()) if short.any() else window
        self.map = IntMap(self.vocabulary)

    def candidates(self, number: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Words in stretches of benchmark words long enough for a window: outside them none can occur."""
        keep = _long_runs(number > 0, row, self.window)
        if len(self.short_words):
            inside = np.zeros(len(self.vocabulary) + 1, bool)
            inside[self.short_words] = True
            keep |= _long_runs(inside[number], row, self.short_least)
        return keep


def _long_runs(inside: np.ndarray, row: np.ndarray, least: int) -> np.ndarray:
    """Marks the runs of ``inside`` within a row that have at least ``least`` words."""
    n = len(inside)
    if not n:
        return inside.copy()
    begin = np.flatnonzero(np.concatenate([[True], (inside[1:] != inside[:-1]) | (row[1:] != row[:-1])]))
    length = np.diff(np.append(begin, n))
    return np.repeat(inside[begin] & (length >= least), length)


class _Shard:
    """Documents gathered until they fill an index."""

    def __init__(self, windows: Windows):
        self.windows, self.ids, self.n_words, self.parts, self.size = windows, [], [], [], 0

    def add(self, ids: list, data: np.ndarray, offsets: np.ndarray) -> None:
        hashes, firsts = WORDS.hashes(data, offsets)
        rows = np.repeat(np.arange(len(ids)), np.diff(firsts))
        number = self.windows.map.find(hashes).astype(np.int64) + 1
        keep = np.flatnonzero(self.windows.candidates(number, rows))
        if len(keep):
            self.parts.append((rows[keep] + len(self.ids), keep - firsts[rows[keep]], number[keep]))
            self.size += len(keep)
        self.ids += ids
        self.n_words += np.diff(firsts).tolist()

    def result(self) -> pa.RecordBatch:
        n, w = len(self.ids), self.windows
        spans: list[list[dict]] = [[] for _ in range(n)]
        items: list[list[str]] = [[] for _ in range(n)]
        if self.parts:
            row, place, number = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)])
            # a separator stands behind each stretch: word k of the gathered words is at k plus the stretches before its own
            at = np.arange(len(row)) + np.cumsum(new) - 1
            text = np.zeros(len(row) + int(new.sum()), np.int64)
            text[at] = number
            index = FMIndex(text, len(w.vocabulary))
            lo, hi = index.search(w.rows, w.lengths)
            found = np.flatnonzero(hi > lo)
            if len(found):
                size = (hi - lo)[found]
                within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                which = np.repeat(found, size)
                where = np.searchsorted(at, index.locate(np.repeat(lo[found], size) + within))
                doc, first = row[where], place[where]
                self._merge(spans, doc, first, first + w.lengths[which])
                many = np.diff(w.owner_at)[which]
                owner = w.owner[np.repeat(w.owner_at[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                pair = np.unique(np.repeat(doc, many) * len(w.names) + owner)
                for d, o in zip((pair // len(w.names)).tolist(), (pair % len(w.names)).tolist(), strict=True):
                    items[d].append(w.names[o])
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids, pa.int64()), pa.array(self.n_words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))],
            ["doc_id", "n_words", "spans", "items"],
        )

    @staticmethod
    def _merge(spans: list[list[dict]], doc: np.ndarray, first: np.ndarray, end: np.ndarray) -> None:
        by = np.lexsort((first, doc))
        for d, a, b in zip(doc[by].tolist(), first[by].tolist(), end[by].tolist(), strict=True):
            if spans[d] and a <= spans[d][-1]["last"] + 1:
                spans[d][-1]["last"] = max(spans[d][-1]["last"], b - 1)
            else:
                spans[d].append({"first": a, "last": b - 1})


def _search(windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(windows.value)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            shard.add(batch.column(0).to_pylist(), data, offsets)
            if shard.size >= SHARD_WORDS or len(shard.ids) >= 20_000:
                yield shard.result()
                shard = _Shard(windows.value)
        if shard.ids:
            yield shard.result()

    return run


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items on the driver, one bounded block after another."""
    block, size = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).where("t is not null").toLocalIterator():
        block.append((r.i, r.t))
        size += len(r.t)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: its words, the merged spans of hit words (first and last word), and the items found."""
    spark = docs.sparkSession
    arrow_batches(spark)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = _blocks(spark, benchmark, window, block_bytes)
    if len(blocks) == 1:
        return narrow.mapInArrow(serving("windows", _search(blocks[0])), RESULT)
    rows = written(narrow.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = _search_all(rows.select("_row", "text"), blocks)
    return rows.select("_row", "doc_id").join(found, "_row").select("doc_id", "n_words", "spans", "items")


def _blocks(spark, benchmark: DataFrame, window: int, block_bytes: int) -> list:
    """The windows of every block as broadcasts; of a benchmark without items one empty block."""
    return [spark.sparkContext.broadcast(Windows(block, window)) for block in benchmark_blocks(benchmark, block_bytes)] or [spark.sparkContext.broadcast(Windows([], window))]


def _search_all(rows: DataFrame, blocks: list) -> DataFrame:
    """Per row of (_row, text): _row, n_words, and the spans and items of all blocks."""
    every = None
    for windows in blocks:
        found = rows.mapInArrow(serving("windows", _search(windows)), RESULT)
        every = found if every is None else every.unionByName(found.where(F.size("spans") > 0))  # the first block has a line for each row
    merged = every.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("s"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return merged.mapInArrow(_joined_spans, merged.schema).select(F.col("doc_id").alias("_row"), "n_words", F.col("s").alias("spans"), "items")


def _joined_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.schema.names.index("s")
        joined = []
        for spans in batch.column(k).to_pylist():
            out: list[dict] = []
            for x in sorted(spans, key=lambda x: (x["first"], x["last"])):
                if out and x["first"] <= out[-1]["last"] + 1:
                    out[-1]["last"] = max(out[-1]["last"], x["last"])
                else:
                    out.append(dict(x))
            joined.append(out)
        yield batch.set_column(k, batch.schema.field(k), pa.array(joined, batch.schema.field(k).type))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the words of any benchmark window; a document that consists of them alone goes.

    Keeps all columns; where there is an ``n_chars`` it follows the new text.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    blocks = _blocks(spark, benchmark, window, block_bytes)
    if len(blocks) == 1:
        return docs.mapInArrow(serving("windows", _cut(blocks[0], docs.columns)), docs.schema)
    # as in one block: what all blocks hit is cut at once, and texts that were cut are searched again until no window is left
    row, new = (next(n for k in range(len(docs.columns) + 1) if (n := f"_{name}{k}") not in docs.columns) for name in ("row", "new"))
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    now, rounds = numbered.select(F.col(row).alias("_row"), F.col("text").cast("string").alias("text")), []
    while True:
        hits = _search_all(now, blocks).where(F.size("spans") > 0).select("_row", "spans")
        now = written(now.join(hits, "_row").mapInArrow(serving("windows", _remove), "_row long, text string"), "cut")
        if now.isEmpty():
            break
        rounds.append(now.withColumn("round", F.lit(len(rounds))))
        now = now.where("text != ''")
    if not rounds:
        return numbered.select(docs.columns)
    last = reduce(DataFrame.unionByName, rounds).groupBy("_row").agg(F.max_by("text", "round").alias(new)).withColumnRenamed("_row", f"{new}_row")
    out = numbered.join(last, numbered[row] == last[f"{new}_row"], "left").where(F.col(new).isNull() | (F.col(new) != ""))
    changed = {"text": F.col(new), "n_chars": F.length(new)}
    return out.select(*(F.coalesce(changed[c].cast(docs.schema[c].dataType), F.col(c)).alias(c) if c in changed else F.col(c) for c in docs.columns))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_row, text, spans) to (_row, text without the spans)."""
    for batch in batches:
        texts = [_removed(t, c) for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_row", "text"])


def _cut(windows, names: list[str]):
    number = names.index("text")

    def emit(shard: _Shard, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, at = shard.result().column(2).to_pylist(), 0
        for batch in held:
            cuts, at = spans[at : at + len(batch)], at + len(batch)
            if any(cuts):
                texts = [_without(t, c, windows.value) if c else t for t, c in zip(batch.column(number).to_pylist(), cuts, strict=True)]
                keep = [bool(t) or not c for t, c in zip(texts, cuts, strict=True)]
                batch = batch.set_column(number, batch.schema.field(number), pa.array(texts, batch.schema.field(number).type))
                if "n_chars" in names:
                    k = names.index("n_chars")
                    n = [len(t) if c else o for t, c, o in zip(texts, cuts, batch.column(k).to_pylist(), strict=True)]
                    batch = batch.set_column(k, batch.schema.field(k), pa.array(n).cast(batch.schema.field(k).type))
                batch = batch.filter(pa.array(keep))
            yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, size = _Shard(windows.value), [], 0
        for batch in batches:
            data, offsets = utf8(batch.column(number))
            shard.add([0] * len(batch), data, offsets)
            held.append(batch)
            size += len(data)
            if shard.size >= SHARD_WORDS or size >= HELD_BYTES:
                yield from emit(shard, held)
                shard, held, size = _Shard(windows.value), [], 0
        yield from emit(shard, held)

    return run


def _removed(text: str, cuts: list[dict]) -> str:
    """The text without the hit words; empty if no word is left."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    _, starts, ends, _ = WORDS.edges(data, np.array([0, len(raw)]))
    parts, at = [], 0
    for c in cuts:
        if c["first"] >= len(starts):
            continue
        parts.append(raw[at : starts[c["first"]]])
        at = ends[min(c["last"], len(ends) - 1)]
    parts.append(raw[at:])
    text = b" ".join(p.strip() for p in parts if p.strip()).decode()
    return text if WORDS.hashes(*utf8(pa.array([text])))[0].size else ""


def _without(text: str, cuts: list[dict], windows: Windows) -> str:
    """The text without the hit words; what then comes together is searched again until no window is left."""
    while cuts and (text := _removed(text, cuts)):
        shard = _Shard(windows)
        shard.add([0], *utf8(pa.array([text])))
        cuts = shard.result().column(2).to_pylist()[0]
    return text


def digest(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The contract's columns, derived from the operator's spans and items."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return contamination(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def brute_force(texts: list[tuple[int, str | None]], items: list[tuple[str, str | None]], window: int = 10) -> list[tuple]:
    """The same digest by plain comparison of every window; for tests."""
    import re

    split = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    words = lambda t: split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    found = []
    wins = {}
    for name, text in items:
        w = words(text)
        for k in range(0, max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(name)
    for doc_id, text in texts:
        w, hit, names = words(text), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (key := tuple(w[k : k + size])) in wins:
                    hit |= {*range(k, k + size)}
                    names |= wins[key]
        found.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return found


#: DuckDB SQL for ``digest`` over the tables documents and benchmark.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT coalesce(cast(item_id AS varchar), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS r(k) WHERE len(w) > 0
), hits AS (
  SELECT doc_id, k, size, item FROM (
    SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS win
    FROM d, (SELECT DISTINCT size FROM wins) AS s, unnest(range(1, len(w) - size + 2)) AS r(k)
  ) AS x JOIN wins USING (size, win)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, k, size FROM hits) AS h, unnest(range(k, k + size)) AS r(p) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) AS i GROUP BY doc_id
)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, cast(coalesce(covered.n, 0) AS bigint) AS n_hit, cast(coalesce(named.n, 0) AS bigint) AS n_items,
       sha256(coalesce(named.items, '')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
