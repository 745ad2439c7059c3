"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of orders 0 to ``ORDER`` with the
counts of the bytes that followed.  The counts are frozen after training.  The
code length of a byte is ``log2((n + q) / c)`` in the longest context that was
followed by it, plus ``log2((n + q) / q)`` for every longer known context that
had to be escaped (n occurrences, q distinct followers, c of this byte); an
unseen byte costs 8 bits.  A text gets the language of the shortest code.

Texts are lower-cased; ASCII characters that are no letters count as one space,
runs of spaces as one; the text's start is a context of its own.

Training reads up to ``TRAIN_DOCS`` labelled documents of each of the
``LANGUAGES`` most frequent languages, those with the smallest hashes of their
id, of at most ``TRAIN_CHARS`` characters; of a repeated id one text counts.
Everything else covers all rows and whole texts.

Defined cases: ``und`` with score 0 for null text, text without a letter, or
when no labelled document was found; ties go to the first language by name;
repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permaway.llm.arrays import IntMap
from permaway.llm.sampling import least_hashed
from permaway.llm.storage import arrow_batches
from permaway.llm.workers import serving

ORDER = 4
TRAIN_DOCS = 400
TRAIN_CHARS = 20_000
LANGUAGES = 200
#: Bytes scored by one numpy pass.
PASS = 1 << 18
#: The score weighs the margin per byte as if of this many bytes at most.
WEIGHT = 48
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}").search
_TABLE = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def _folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts, ``ORDER`` zero bytes before each, and the text of every byte."""
    parts = [(t or "").lower().encode().translate(_TABLE) for t in texts]
    data = np.frombuffer(b"".join(bytes(ORDER) + p for p in parts), np.uint8)
    row = np.repeat(np.arange(len(parts)), [len(p) + ORDER for p in parts])
    keep = data != 32
    keep[1:] |= data[:-1] != 32
    return data[keep], row[keep]


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """At each byte, it and the ``order`` bytes before it as one number."""
    out = data.astype(np.uint64)
    for k in range(1, order + 1):
        out[k:] |= data[:-k].astype(np.uint64) << np.uint64(8 * k)
    return out


class Model:
    """Frozen statistics of all languages, as code lengths of every known context and byte."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        counted = [self._count(samples[x]) for x in self.languages]
        width = len(self.languages)
        self.maps, self.cost, self.contexts, self.escape = [], [], [], []
        for d in range(ORDER + 1):
            keys = np.unique(np.concatenate([c[d][0] for c in counted])) if counted else np.zeros(0, np.uint64)
            context = keys >> np.uint64(8)
            contexts, group = np.unique(context, return_inverse=True)
            known = IntMap(keys)
            # what a byte costs once its longest context is escaped
            if d:
                shorter = self.cost[d - 1][self.maps[d - 1].find(keys & np.uint64((1 << (8 * d)) - 1))]
            else:
                shorter = np.full((len(keys), width), 8.0, np.float32)
            cost, escape = np.array(shorter, np.float32), np.zeros((len(contexts), width), np.float32)
            for x, c in enumerate(counted):
                count = np.zeros(len(keys))
                count[np.searchsorted(keys, c[d][0])] = c[d][1]
                total = np.bincount(group, count, len(contexts))
                distinct = np.bincount(group, count > 0, len(contexts))
                seen = total > 0
                leave = np.where(seen, np.log2(np.maximum(total + distinct, 1) / np.maximum(distinct, 1)), 0)
                hit = count > 0
                cost[:, x] += leave[group]
                cost[hit, x] = np.log2((total + distinct)[group[hit]] / count[hit])
                escape[:, x] = leave
            self.maps.append(known)
            self.cost.append(cost)
            self.contexts.append(IntMap(contexts))
            self.escape.append(escape)

    @staticmethod
    def _count(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each order the numbers of context and byte, and how often they occurred."""
        found: list[tuple[list, list]] = [([], []) for _ in range(ORDER + 1)]
        for k in range(0, len(texts), 64):
            data, _ = _folded(texts[k : k + 64])
            real = data != 0
            for d in range(ORDER + 1):
                key, n = np.unique(_grams(data, d)[real], return_counts=True)
                found[d][0].append(key)
                found[d][1].append(n)
        out = []
        for keys, counts in found:
            key, back = np.unique(np.concatenate(keys or [np.zeros(0, np.uint64)]), return_inverse=True)
            out.append((key, np.bincount(back, np.concatenate(counts or [np.zeros(0)]), len(key))))
        return out

    def code_lengths(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of every text under every language, and the bytes that were coded."""
        bits, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        data, row = _folded(texts)
        for lo in range(0, len(data), PASS):
            a = max(0, lo - ORDER)
            part = data[a : lo + PASS]
            at = np.flatnonzero(part != 0)
            at = at[at >= lo - a]
            cost = np.zeros((len(at), len(self.languages)), np.float32)
            left = np.arange(len(at))
            full = _grams(part, ORDER)[at]
            for d in range(ORDER, -1, -1):
                key = full[left] & np.uint64((1 << (8 * d + 8)) - 1)
                found = self.maps[d].find(key)
                hit = found >= 0
                cost[left[hit]] += self.cost[d][found[hit]]
                left, key = left[~hit], key[~hit]
                if not len(left):
                    break
                context = self.contexts[d].find(key >> np.uint64(8))
                known = context >= 0
                cost[left[known]] += self.escape[d][context[known]]
                if not d:
                    cost[left] += 8
            which = row[a : lo + PASS][at]
            for x in range(len(self.languages)):
                bits[:, x] += np.bincount(which, cost[:, x], len(texts))
            sizes += np.bincount(which, minlength=len(texts))
        return bits, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and bits per byte of the best code."""
        names, scores, rates = [], [], []
        bits, sizes = self.code_lengths(texts) if self.languages else (None, None)
        for k, t in enumerate(texts):
            if not self.languages or not t or not _LETTER(t) or not sizes[k]:
                names.append(UNKNOWN)
                scores.append(0.0)
                rates.append(8.0)
                continue
            best = int(np.argmin(bits[k]))
            margin = (bits[k] - bits[k][best]) / sizes[k] * min(sizes[k], WEIGHT)
            names.append(self.languages[best])
            scores.append(float(1 / np.sum(np.exp2(-margin))))
            rates.append(float(bits[k][best] / sizes[k]))
        return names, scores, rates


def training_rows() -> Column:
    """The documents whose labels may be learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2


def train(docs: DataFrame, rows: Column | None = None, docs_per_language: int = TRAIN_DOCS) -> Model:
    """Learns from a bounded sample of the labelled documents that ``rows`` selects."""
    able = docs.where(training_rows() if rows is None else rows).select(F.col("doc_id").alias("d"), F.col("lang").cast("string").alias("y"), F.col("text").cast("string").alias("t"))
    able = able.where(F.col("d").isNotNull() & F.col("y").isNotNull() & (F.length("t") <= TRAIN_CHARS))
    picked = F.broadcast(least_hashed(able, docs_per_language, LANGUAGES))
    samples: dict[str, list[str]] = {}
    for r in able.join(picked, ["d", "y"]).groupBy("d", "y").agg(F.min("t").alias("t")).orderBy("d", "y").collect():  # bounded by docs_per_language and LANGUAGES
        samples.setdefault(r.y, []).append(r.t)
    return Model(samples)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, lang_pred, score, bits_per_byte."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, _predicted(shared.value, batch.column(1)))], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(serving("language", run), "doc_id long, lang_pred string, score double, bits_per_byte double")


def _predicted(model: Model, column: pa.Array, most: int = 1 << 20) -> tuple[list[str], list[float], list[float]]:
    """Predictions for a column, a few megabytes of text at a time."""
    names, scores, rates, held, size = [], [], [], [], 0
    for text in [*column.to_pylist(), None]:
        held.append(text)
        size += len(text or "")
        if size > most:
            for into, got in zip((names, scores, rates), model.predict(held), strict=True):
                into += got
            held, size = [], 0
    for into, got in zip((names, scores, rates), model.predict(held), strict=True):
        into += got
    return names[:-1], scores[:-1], rates[:-1]


def keep_identified(docs: DataFrame, model: Model, languages: tuple[str, ...] | None = None, most_bits: float = 8.0) -> DataFrame:
    """``docs`` whose shortest code is of one of ``languages`` (None: of any learned one) and takes less than ``most_bits`` bits a byte."""
    arrow_batches(docs.sparkSession)
    shared, number = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _, rates = _predicted(shared.value, batch.column(number))
            yield batch.filter(pa.array([n != UNKNOWN and (languages is None or n in languages) and r < most_bits for n, r in zip(names, rates, strict=True)], pa.bool_()))

    return docs.mapInArrow(serving("language", run), docs.schema)


def digest(docs: DataFrame, model: Model) -> DataFrame:
    """The contract's columns."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    return identify(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")
