"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton over folded text.

Folding: compatibility forms and marks are removed, letters of other scripts that
look like Latin ones become those, digits and signs inside words become the
letters they stand for, capitals become small, and everything else is a space.

The lexicon holds words and word beginnings (stems, for languages that inflect)
with the weight of evidence that labelled documents give them, next to a short
list of insults known beforehand.  An exception phrase cancels the hits it
covers: a fixed list, and two-word phrases that clean documents hold as a rule.
The score is a logistic function of the hits' weight, of that weight per hundred
words, and of the number of different entries hit; a text without hits keeps the
base score.

Learning reads up to ``TRAIN_DOCS`` labelled documents of each label, those with
the smallest hashes of their id, of at most ``TRAIN_CHARS`` characters; of a
repeated id one text counts.  Scoring covers all
rows and whole texts.  Defined cases: null or empty text has no hits; repeated
rows get equal scores; a document with several labels counts with its largest;
without labels only the known insults count.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from permaway.llm.sampling import least_hashed
from permaway.llm.storage import arrow_batches

TRAIN_DOCS = 2000
TRAIN_CHARS = 20_000
#: An entry needs this many toxic documents and this log-odds of toxic against clean ones.
SUPPORT, LEAST_ODDS = 4, 3.0
#: Shortest and longest learned stem.
STEM = (4, 9)
#: A phrase of clean documents cancels a hit if it occurs in this many of them and in no more toxic ones.
CLEAN_SUPPORT = 3

#: Insults known beforehand, with their weights.
KNOWN = {"idiot": 3.0, "moron": 3.0, "scum": 3.0, "stupid": 2.0, "worthless": 2.0, "pathetic": 2.0, "disgusting": 2.0, "loser": 2.5, "trash": 1.5, "clown": 1.5, "imbecile": 3.0, "bastard": 3.0, "retard": 3.0, "dumbass": 3.0}
#: Phrases in which such words are harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "clown nose", "class clown", "circus clown", "stupid question", "sore loser", "pond scum", "soap scum", "oxy moron")

#: Letters of other scripts by the Latin letter they look like.
HOMOGLYPHS = {
    "a": "аαɑ", "b": "ЬВβ", "c": "сϲ", "d": "ԁ", "e": "еєε", "g": "ɡ", "h": "һ", "i": "іιıӏ", "j": "ј", "k": "кκ", "l": "ⅼ", "m": "м",
    "n": "пη", "o": "оοσ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уүγ", "z": "ᴢ",
}
#: Letters by the digit or sign that replaces them inside a word.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e", "£": "l"}

_LOOKS = {ord(c): latin for latin, seen in HOMOGLYPHS.items() for c in seen + seen.upper()}
_STANDS = {ord(k): v for k, v in DIGITS.items()}
#: Digits and signs between letters; a run at a word's end counts only as digits (so that "re!!" stays "re").
_INSIDE = regex.compile(r"(?<=\p{L})[0-9@$!|€£]{1,2}(?=\p{L})|(?<![\p{L}0-9])[0134579@$](?=\p{L}[\p{L}0-9@$!|])|(?<=\p{L}{2})[0134579](?![\p{L}0-9])")
_SPLIT = regex.compile(r"(?<=\p{L})[­​-‍⁠﻿](?=\p{L})")
_WORD = regex.compile(r"\p{L}+")
_PLAIN = regex.compile(r"[^\x00-ɏ]")
_SPELLED = regex.compile(r"(?<!\p{L})(?:\p{L}[ .\-_*]){3,}\p{L}(?!\p{L})")


def fold(text: str | None) -> str:
    """Folded words between single spaces, one space before and after; letters keep their accents."""
    if not text:
        return " "
    if _PLAIN.search(text):
        text = unicodedata.normalize("NFKC", _SPLIT.sub("", text)).translate(_LOOKS)
    elif "­" in text:
        text = _SPLIT.sub("", text)
    text = _INSIDE.sub(lambda m: m[0].translate(_STANDS), text)
    if _SPELLED.search(text):
        text = _SPELLED.sub(lambda m: "".join(_WORD.findall(m[0])), text)
    return " " + " ".join(_WORD.findall(text.lower())) + " "


class Lexicon:
    """The automaton of weighted entries and exception phrases, and the curve from hits to a score."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], exceptions: set[str], curve: np.ndarray | None = None):
        self.entries = {f" {w} ": v for w, v in words.items()} | {f" {s}": v for s, v in stems.items()}
        self.exceptions = {f" {p} " for p in exceptions}
        self.curve = np.array([-4.0, 3.0, 0.3, 0.8]) if curve is None else curve
        self._machine = None

    def __getstate__(self):
        return {**self.__dict__, "_machine": None}

    def _automaton(self) -> ahocorasick.Automaton:
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for k in {*self.entries, *self.exceptions}:
                self._machine.add_word(k, (len(k), self.entries.get(k, 0.0), k in self.exceptions))
            if len(self._machine):
                self._machine.make_automaton()
        return self._machine

    def features(self, folded: str) -> tuple[float, float, float]:
        """log(1 + weight), weight per hundred words, different entries hit."""
        machine = self._automaton()
        if not len(machine):
            return 0.0, 0.0, 0.0
        hits, safe = [], []
        for end, (size, weight, harmless) in machine.iter(folded):
            if harmless:
                safe.append((end - size + 1, end))
            if weight:
                hits.append((end - size + 1, end, weight))
        safe.sort()
        starts, reach = [x for x, _ in safe], list(accumulate((y for _, y in safe), max))
        best: dict[int, tuple[float, int]] = {}  # the strongest entry at each word
        for a, b, w in hits:
            before = bisect_right(starts, a)  # phrases that begin no later: one covers the hit if their furthest end does
            if not (before and reach[before - 1] >= b) and w > best.get(a, (0.0, 0))[0]:
                best[a] = (w, b)
        total = sum(w for w, _ in best.values())
        kinds = len({folded[a : b + 1].strip() for a, (_, b) in best.items()})
        return math.log1p(total), 100 * total / max(20, folded.count(" ") - 1), math.log1p(kinds)

    def score(self, text: str | None) -> float:
        f = self.features(fold(text))
        z = float(self.curve[0] + self.curve[1:] @ np.array(f))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _odds(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.25) / (n_toxic + 0.5)) - math.log((clean + 0.25) / (n_clean + 0.5))


def learn(toxic: list[str], clean: list[str]) -> Lexicon:
    """Weights of words and stems by their odds, exception phrases of clean texts, and the fitted curve."""
    folded = ([fold(t) for t in toxic], [fold(t) for t in clean])
    words, stems, clean_pairs = (Counter(), Counter()), (Counter(), Counter()), Counter()
    starts = lambda own: {w[:n] for w in own for n in range(STEM[0], min(STEM[1], len(w)) + 1)}
    for f in folded[0]:
        own = set(f.split())
        words[0].update(own)
        stems[0].update(starts(own))
    # only what enough toxic texts hold is counted in clean ones
    stems = (Counter({s: n for s, n in stems[0].items() if n >= 2 * SUPPORT}), Counter())
    for f in folded[1]:
        own = set(f.split())
        words[1].update(own & words[0].keys())
        stems[1].update(starts(own) & stems[0].keys())
    n1, n0 = len(toxic), len(clean)
    strong: dict[str, float] = dict(KNOWN)
    if n1 and n0:
        for w, n in words[0].items():
            if len(w) >= 3 and n >= SUPPORT and (o := _odds(n, words[1][w], n1, n0)) >= LEAST_ODDS:
                strong[w] = min(6.0, o)
        for w in list(strong):
            if words[1][w] > words[0][w] * n0 / n1:
                del strong[w]
    # a word that stays within a few documents in a row of copies is chance: it must be common among toxic texts or share its stem
    roots = {s: n for s, n in stems[0].items() if n >= 2 * SUPPORT and _odds(n, stems[1][s], n1, n0) >= LEAST_ODDS} if n1 and n0 else {}
    kept_stems = {s: min(6.0, _odds(n, stems[1][s], n1, n0)) for s, n in roots.items() if s[:-1] not in roots and _variants(s, words[0]) >= SUPPORT}
    common = {w: v for w, v in strong.items() if w in KNOWN or words[0][w] >= max(2 * SUPPORT, 0.02 * n1)}
    for f in folded[1]:
        w = f.split()
        clean_pairs.update({f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if a in common or b in common or any(x.startswith(s) for x in (a, b) for s in kept_stems)})
    toxic_pairs = Counter()
    for f in folded[0]:
        w = f.split()
        toxic_pairs.update({p for a, b in zip(w, w[1:], strict=False) if (p := f"{a} {b}") in clean_pairs})
    found = Lexicon(common, kept_stems, {*EXCEPTIONS, *(p for p, n in clean_pairs.items() if n >= CLEAN_SUPPORT and toxic_pairs[p] * n0 <= n * n1 * 0.1)})
    if n1 and n0:
        found.curve = _fit(np.array([found.features(f) for f in [*folded[0], *folded[1]]]), np.repeat([1.0, 0.0], [n1, n0]), found.curve)
    return found


def _variants(stem: str, words: Counter) -> int:
    return sum(w.startswith(stem) for w in words)


def _fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, each label with half of the weight, pulled lightly to ``prior``."""
    x = np.column_stack([np.ones(len(x)), x])
    sample = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w, pull = prior.copy(), np.array([0.02, 2.0, 2.0, 2.0])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(sample * (np.logaddexp(0, z) - y * z)) + 0.5 * np.sum(pull * (w - prior) ** 2))

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (sample * (p - y)) + pull * (w - prior)
        step = np.linalg.solve((x * (sample * p * (1 - p))[:, None]).T @ x + np.diag(pull), grad)
        size, before = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > before:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, docs_per_label: int = TRAIN_DOCS) -> Lexicon:
    """Learns from a bounded sample of the labelled documents whose crc32(doc_id) mod 5 is not 0."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("d")).agg((F.max("toxic") >= 1).alias("y"))
    marked = marked.where(F.pmod(F.crc32(F.col("d").cast("string")), F.lit(5)) != 0)
    picked = least_hashed(marked, docs_per_label, 2)
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("t")).where(F.length("t") <= TRAIN_CHARS)
    sides: tuple[list, list] = ([], [])
    for r in texts.join(F.broadcast(picked), "d").groupBy("d", "y").agg(F.min("t").alias("t")).collect():  # bounded by docs_per_label
        sides[0 if r.y else 1].append(r.t)
    return learn(*(sorted(s) for s in sides))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per document: doc_id, score."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def digest(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The contract's columns."""
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return score(docs, lexicon).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
