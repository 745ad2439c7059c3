"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct word shingles; its sketch keeps the k smallest
of their hashes.  Steps:

1. Documents with equal sets (128-bit digest and size) form a class; one stands for it.
2. Inverted lists of retained values.  Two sets with similarity 0.8 share at
   least ``overlap`` retained values, so they share one of their rarest
   ``retained - overlap + 1``: only those stay.  Values of passages that many
   documents hold come last in that order and drop out of the lists.  A class
   in no list has no link.
3. The classes in some list are listed anew, by their full sets and exactly: sets
   of n values with similarity 0.8 share one of their rarest n - ceil(0.8 n) + 1.
   A value's position among the rarest bounds what two sets can still share.
   A list of up to ``SMALL`` classes gives all its pairs.
4. A larger list is split by size, as linked sets differ by a factor of 1.25 at
   most, and gives a star around its hub, the set with the least share of values
   rarer than the list's own.  After the links of all stars are merged into components, only pairs
   of different components matter: further stars have hubs outside the largest
   component of their list, and what is left then is compared by differences (5).
5. With D the values in which a set differs from the hub of its list, x and y differ
   in ``|Dx| + |Dy| - 2 |Dx and Dy|`` values.  A set that the star did not link must
   therefore share so many *differences* with whatever it is linked with; those are
   few and rare, and are listed as the values were before (rarest first, with
   positions).  That is exact, and a group of near copies of one text makes
   no list of them all again.
6. The union of two sketches estimates the similarity; far pairs go.  The exact
   similarity of the full sets decides every link.
7. Components of the links, by written rounds of large-star and small-star.

``overlap`` for a whole set of n <= k values is exact, ceil(0.8 n) (48 at most, as the
partner may be a little larger than its sketch); for a larger set it is 32 of
64.  Two steps are inexact, by binomial tails for a pair at exactly 0.8: the first
list misses it with probability 1.9e-8, the estimate by ``ESTIMATED`` values with
2.7e-8.

Defined cases: null, empty or wordless text has no set, is linked with nothing
and is its own component; fewer words than a shingle make one shingle of all
words; equal ids are one node, with the links of all their texts; a null id is
its own component; ties by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from permaway.llm.arrays import Words, groups_of, mix64, utf8
from permaway.llm.components import components
from permaway.llm.storage import arrow_batches, written
from permaway.llm.workers import serving

#: White space separates words; everything else belongs to them.
WORDS = Words(bytes([0x20, *range(0x09, 0x0E)]))
RETAINED = 64
#: Retained values by which candidate pairs are estimated before their full sets are read.
ESTIMATED = 128
#: Classes of a list that still gives all its pairs.
SMALL = 16
#: Rounds of stars before the remaining pairs of a list are compared by their differences.
STARS = 2
#: Documents whose ids are broadcast to pick their texts; beyond it the join shuffles.
PICKED = 500_000

_FACTORS = mix64(np.arange(11, 75, dtype=np.uint64)) | np.uint64(1)
_FLIP = np.uint64(1 << 63)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes in ascending order."""
    data, offsets = utf8(texts)
    for a, b in groups_of(offsets):
        words, firsts = WORDS.hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n = len(words) - size + 1
        if n > 0:
            mixed = np.zeros(n, np.uint64)
            for k in range(size):
                mixed += words[k : k + n] * _FACTORS[k]
            mixed = mix64(mixed)
        for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            if hi - lo >= size:
                yield np.unique(mixed[lo : hi - size + 1])
            elif hi > lo:
                yield mix64(np.array([np.sum(words[lo:hi] * _FACTORS[: hi - lo]) + np.uint64(hi - lo)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def _longs(sets: list[np.ndarray]) -> pa.Array:
    """Unsigned values as signed ones of the same order."""
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    flat = (np.concatenate(sets) ^ _FLIP).view(np.int64) if sets else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def _sketches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, kept = [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                one.append(np.sum(mix64(s)))
                two.append(np.sum(mix64(s ^ _FACTORS[0])))
                kept.append(s[:RETAINED])
            sums = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *sums, _longs(kept)], ["doc_id", "n", "d1", "d2", "sketch"])

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), size))
            yield pa.RecordBatch.from_arrays([batch.column(0), _longs([s[:ESTIMATED] for s in sets]), _longs(sets)], ["id", "sketch", "full"])

    return run


class _Links:
    """Verifies candidate pairs against the sets of all documents that stand in a list."""

    def __init__(self, sets: DataFrame, percent: int):
        self.sets, self.percent = sets, percent

    def of(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of different classes to the links among them."""
        side = lambda x, c: self.sets.select(F.col("id").alias(x), F.col(c).alias(f"{c}_{x}"))
        near = pairs.distinct().join(side("a", "sketch"), "a").join(side("b", "sketch"), "b")
        union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, ESTIMATED)
        both = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b")))
        least = self.percent / 100 - 6 * (self.percent / 100 * (1 - self.percent / 100) / ESTIMATED) ** 0.5
        near = near.where(both >= least * F.size(union)).select("a", "b")
        common = F.size(F.array_intersect("full_a", "full_b"))
        exact = near.join(side("a", "full"), "a").join(side("b", "full"), "b").withColumn("i", common)
        return exact.where(F.lit(100) * F.col("i") >= F.lit(self.percent) * (F.size("full_a") + F.size("full_b") - F.col("i"))).select("a", "b")


def _sized(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that can reach the similarity by their sizes and by what follows the value they meet in."""
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    able = (F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")) & (left * (100 + percent) >= F.lit(percent) * (F.col("na") + F.col("nb")))
    return pairs.where((F.col("a") != F.col("b")) & able).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _rarest(sets: DataFrame, values: str, keep: Column, keys: tuple[str, ...] = ("id", "n"), within: tuple[str, ...] = ()) -> DataFrame:
    """(v, keys, p, size): each set's first ``keep`` (of keys and k) values in ascending order of frequency, where at least two sets meet.

    p counts the values before; sets of different ``within`` (some of the keys) never meet.
    """
    by = [*within, "v"]
    postings = sets.select(*keys, F.size(values).alias("k"), F.explode(values).alias("v"))
    often = postings.groupBy(*by).agg(F.count("*").alias("df")).where("df > 1")
    shared = postings.join(often, by).groupBy(*keys, "k").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("s"))
    alone = F.col("k") - F.size("s")  # values of no other set are the rarest
    shared = shared.withColumn("alone", alone).withColumn("take", keep - F.col("alone")).where("take > 0")
    kept = shared.select(*keys, "alone", F.posexplode(F.slice("s", F.lit(1), F.col("take").cast("int"))).alias("p", "x"))
    kept = kept.select(F.col("x.v").alias("v"), *keys, (F.col("p") + F.col("alone")).alias("p"))
    return kept.join(kept.groupBy(*by).agg(F.count("*").alias("size")).where("size > 1"), by)


def _share(percent: int) -> Column:
    return F.floor((F.col("n") * percent + 99) / F.lit(100)).cast("long")


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """(id): classes that meet another in a retained value among their rarest."""
    overlap = F.when(F.col("n") > RETAINED, F.lit(RETAINED // 2)).otherwise(F.least(_share(percent), F.lit(RETAINED * 3 // 4)))
    return _rarest(classes, "sketch", F.col("k") - overlap + 1).select("id").distinct()


def _by_size(large: DataFrame, percent: int) -> DataFrame:
    """Large lists, each split into overlapping bands of sizes: sets that can be linked meet in a band, and a band spans a factor of 1.5625."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent)))
    return large.withColumn("g", F.explode(F.array(band - 1, band))).withColumn("v", F.xxhash64("v", "g")).drop("g")


def link_classes(docs: DataFrame, sketches: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, id) of every row with a set, id standing for its class; and (id, component) of the linked classes."""
    spark = docs.sparkSession
    some = sketches.where("n > 0 and doc_id is not null")
    best = some.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "sketch")).alias("x")).select("n", "d1", "d2", F.col("x.doc_id").alias("id"), F.col("x.sketch").alias("sketch"))
    classes = written(best, "classes")
    members = written(some.select("doc_id", "n", "d1", "d2").join(classes.select("n", "d1", "d2", "id"), ["n", "d1", "d2"]).select("doc_id", "n", "id"), "members")
    # equal ids are one node: their classes are linked
    several = members.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("doc_id", "a")
    same = members.join(several, "doc_id").where("a < id").select("a", F.col("id").alias("b"))
    ids = written(_candidates(classes, percent), "candidates")
    picked = ids.count()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(ids) if picked <= PICKED else ids, "id", "left_semi")
    sets = written(texts.mapInArrow(serving("shingles", _full_sets(shingle)), "id long, sketch array<long>, full array<long>"), "sets").withColumn("n", F.size("full"))
    links_of = _Links(sets, percent).of
    lists = written(_rarest(sets, "full", F.col("k") - _share(percent) + 1), "lists")

    small = lists.where(F.col("size") <= SMALL).select("v", "id", "n", "p")
    pairs = _side(small, "a").join(_side(small, "b"), "v").where("a < b")
    large = written(_by_size(lists.where(F.col("size") > SMALL), percent).select("v", "id", "n", "p"), "large")
    first = _hubs(large)
    stars = _side(large, "a").join(_side(first, "b"), "v")
    columns = ["a", "na", "pa", "b", "nb", "pb"]
    links = links_of(_sized(pairs.select(columns).unionByName(stars.select(columns)), percent))
    links = written(links.unionByName(same), "links")
    found = written(components(links), "components")
    starring = STARS
    while True:
        c = found.select("id", F.col("component").alias("c"))
        marked = large.join(c, "id", "left").withColumn("c", F.coalesce("c", "id"))
        mixed = marked.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("v")
        open_ = written(marked.join(mixed, "v"), "open")
        if open_.isEmpty():
            return members, found
        if starring > 0:
            main = open_.groupBy("v", "c").agg(F.count("*").alias("k")).groupBy("v").agg(F.max_by("c", F.struct("k", "c")).alias("main"))
            outside = open_.join(main, "v").where("c <> main").drop("main")
            more = _side(open_, "a").join(_side(_hubs(outside), "b"), "v").where("ca <> cb")
            fresh = written(links_of(_sized(more.select(columns), percent)), "fresh")
            starring -= 1
        if starring == 0 or fresh.isEmpty():
            fresh = written(fresh.unionByName(_by_differences(open_, sets, links_of, percent)), "fresh")
            starring = -1
        if fresh.isEmpty():
            return members, found
        links = written(links.unionByName(fresh), "links")
        found = written(components(links), "components")
        if starring < 0:
            return members, found


def _by_differences(lists: DataFrame, sets: DataFrame, links_of, percent: int) -> DataFrame:
    """The links between different components of each list, by the differences of its sets from its hub.

    With r = (100 - percent) / (100 + percent), x and y are linked if and only if they
    differ in at most r (nx + ny) values, so they share at least
    (dx + dy - r (nx + ny)) / 2 differences.  One of the two is outside the hub's component.
    """
    hub = _hubs(lists).select("v", F.col("id").alias("h"), F.col("c").alias("hc"))
    members = lists.join(hub, "v").select("h", "hc", "id", "n", "c").distinct()
    full = sets.select("id", "full")
    both = members.join(full, "id").join(full.select(F.col("id").alias("h"), F.col("full").alias("hub")), "h")
    apart = F.array_union(F.array_except("full", "hub"), F.array_except("hub", "full"))
    keys = ("h", "id", "n", "c", "m", "out")
    far = written(both.select("h", "id", "n", "c", F.size("hub").alias("m"), (F.col("c") != F.col("hc")).alias("out"), apart.alias("far")), "differences")
    r = (100 - percent) / (100 + percent)
    k, near = F.col("k"), F.col("k") - r * (F.col("n") + F.col("m"))
    # what any set must share with its partner, and one in the hub's component with a partner outside
    least = F.greatest(near / (1 + r), F.when(F.col("out"), F.lit(0.0)).otherwise((near + (1 - r) * 2 * r * F.col("m") / (1 + r)) / 2))
    least = F.greatest(F.lit(1), F.ceil(least - 1e-6)).cast("int")
    kept = _rarest(far.withColumn("k", F.size("far")), "far", k - least + 1, keys, ("h",))
    sizes = far.select("h", "id", F.size("far").alias("d"))
    kept = written(kept.join(sizes, ["h", "id"]), "differences")
    side = lambda x: kept.select("h", "v", *(F.col(c).alias(f"{c}{x}") for c in ("n", "c", "out", "d", "p")), F.col("id").alias(x))
    pairs = side("a").join(side("b"), ["h", "v"]).where("outa and ca <> cb and (not outb or a < b)")
    able = (F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")) & (F.least(F.col("da") - F.col("pa"), F.col("db") - F.col("pb")) >= (F.col("da") + F.col("db") - r * (F.col("na") + F.col("nb"))) / 2 - 1e-6)
    pairs = pairs.where(able).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # a set that the star's estimate missed
    direct = far.where(F.col("out") & (F.lit(100 + percent) * F.size("far") <= F.lit(100 - percent) * (F.col("n") + F.col("m")))).select(F.least("h", "id").alias("a"), F.greatest("h", "id").alias("b"))
    return links_of(pairs).unionByName(direct.distinct())


def _side(lists: DataFrame, x: str) -> DataFrame:
    return lists.select("v", F.col("id").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", "p", "c") if c in lists.columns))


def _hubs(lists: DataFrame) -> DataFrame:
    """One class of each list, the one with the least share of values rarer than the list's own."""
    rest = F.struct(*(c for c in lists.columns if c != "v"))
    return lists.groupBy("v").agg(F.min_by(rest, F.struct(F.col("p") / F.col("n"), -F.col("n"), F.col("id"))).alias("m")).select("v", "m.*")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest id reachable by links), kept."""
    arrow_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = written(narrow.mapInArrow(serving("shingles", _sketches(shingle)), "doc_id long, n long, d1 long, d2 long, sketch array<long>"), "sketches")
    members, found = link_classes(narrow, sketches, shingle, percent)
    component = F.coalesce("component", "id")
    linked = members.join(found, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
    # rows without a set go with what other rows of their id are linked with
    bare = sketches.where("n = 0 and doc_id is not null").select("doc_id")
    own = members.join(bare.distinct(), "doc_id", "left_semi").join(found, "id", "left").groupBy("doc_id").agg(F.min(component).alias("c"))
    bare = bare.join(own, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id")).select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("c").alias("component_id"), (F.col("c") == F.col("doc_id")).alias("kept"))
    nameless = sketches.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(bare).unionByName(nameless)


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group; rows that repeat the same id stand or fall together."""
    gone = written(near_duplicates(docs, shingle, percent).where("not kept").select(F.col("doc_id").alias("_pw_gone")).distinct(), "gone")
    few = gone.count() <= PICKED
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").cast("long") == F.col("_pw_gone"), "left_anti")


#: DuckDB SQL for four-word shingles and 80 percent over the table documents.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + least(4, len(w)) - 1], ' ') AS g
  FROM w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS r(k) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), rare AS (
  SELECT g FROM s GROUP BY g HAVING count(*) > 1
), shared AS (
  SELECT s.doc_id, s.g FROM s SEMI JOIN rare USING (g)
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shared AS x JOIN shared AS y ON x.g = y.g AND x.doc_id <> y.doc_id
  JOIN n AS na ON na.doc_id = x.doc_id JOIN n AS nb ON nb.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach AS (
  SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach AS r JOIN links AS l ON r.other = l.a
), c AS (
  SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id
)
SELECT w.doc_id, cast(coalesce(n.n, 0) AS bigint) AS n_shingles, cast(least(w.doc_id, coalesce(c.m, w.doc_id)) AS bigint) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(c.m, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
