"""Groups of near copies: no link is lost, and the pairs that are compared stay in proportion to the rows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from permaway.llm import neardup
from tests.llm.test_operators import brute_components, docs

WORDS = [f"w{k}" for k in range(3000)]


def copies(rng, base, n, edits, start):
    out = []
    for k in range(n):
        t = list(base)
        for _ in range(rng.randint(*edits)):
            t[rng.randrange(len(t))] = rng.choice(WORDS)
        out.append((start + k, " ".join(t)))
    return out


def brute_matrix(texts, size=4, percent=80):
    """What ``brute_components`` gives, from one matrix of all common values; and the share of linked pairs."""
    sets = [{tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for w in (t.split() for _, t in texts)]
    often = Counter(g for s in sets for g in s)
    place = {g: k for k, g in enumerate(g for g, n in often.items() if n > 1)}
    held = np.zeros((len(sets), len(place)), np.float32)
    for k, s in enumerate(sets):
        held[k, [place[g] for g in s if g in place]] = 1
    n = np.array([len(s) for s in sets])
    both = (held @ held.T).astype(np.int64)
    linked = 100 * both >= percent * (n[:, None] + n - both)
    np.fill_diagonal(linked, True)
    reach = np.arange(len(sets))
    while (new := np.where(linked, reach, len(sets)).min(1)).tolist() != reach.tolist():
        reach = new
    least = [texts[k][0] for k in reach]
    return {d: (int(k), c, c == d) for (d, _), k, c in zip(texts, n, least, strict=True)}, (linked.sum() - len(sets)) / (len(sets) * (len(sets) - 1))


@pytest.fixture
def compared(monkeypatch):
    """The number of pairs that reach the estimate, call by call."""
    counts = []
    plain = neardup._Links.of

    def of(self, pairs):
        counts.append(pairs.distinct().count())
        return plain(self, pairs)

    monkeypatch.setattr(neardup._Links, "of", of)
    return counts


@pytest.mark.parametrize("original", [True, False])
def test_a_large_group_mostly_below_the_threshold(spark, compared, original):
    """2100 copies of one text with so many edits that four pairs in five are below 0.8; the text itself may stand among them."""
    rng = random.Random(11)
    base = rng.choices(WORDS, k=120)
    texts = copies(rng, base, 2100, (1, 4), 0) + [(5000, " ".join(base))] * original
    want, share = brute_matrix(texts)
    assert 0.05 < share < 0.3
    rows = docs(spark, rng.sample(texts, len(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(rows, 4, 80).collect()}
    assert got == want
    # without an original a fifth of the copies is linked with none: each is held against the few that its differences allow
    assert sum(compared) < (5 * len(texts) if original else 0.06 * len(texts) ** 2 / 2)


def test_groups_of_several_kinds(spark, compared):
    """Families of copies whose originals are near each other, sizes at the edge of the bands, and shared passages in unlike texts."""
    rng = random.Random(12)
    first = rng.choices(WORDS, k=90)
    texts = []
    for family in range(4):
        base = list(first)
        for k in rng.sample(range(90), 3 * family):
            base[k] = rng.choice(WORDS)
        texts += copies(rng, base, 150, (0, 4), 1000 * family)
    passage = rng.choices(WORDS, k=70)
    for k in range(200):
        texts.append((10_000 + k, " ".join(rng.choices(WORDS, k=rng.randint(0, 40)) + passage + rng.choices(WORDS, k=rng.randint(0, 20)))))
    texts += [(20_000 + k, " ".join(first[: 20 + k % 71])) for k in range(142)]
    want = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, texts), 4, 80).collect()}
    assert got == want
    assert 3 < len({c for _, c, _ in want.values()}) < len(want)


def test_equal_ids_are_one_node(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(12)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b), (7, None), (9, c), (9, ""), (11, ""), (11, "!"), (None, a), (None, None), (5, a)]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs(spark, rows), 4, 80).collect())
    want = [("3", 9, 3, True), *[("5", 9, 3, False)] * 3, ("7", 0, 3, False), ("7", 9, 3, False), ("9", 0, 9, True), ("9", 9, 9, True), ("11", 0, 11, True), ("11", 1, 11, True), ("None", 0, None, True), ("None", 9, None, True)]
    assert got == sorted(want)
    assert {r.doc_id for r in neardup.drop_near_duplicates(docs(spark, rows), 4, 80).collect()} == {3, 9, 11, None}
