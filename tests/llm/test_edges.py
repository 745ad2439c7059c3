"""Every operator on nulls, empty and very long texts, repeated ids with different texts, empty tables and columns of any name."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from permaway.llm import ann, decontam, htmltext, langid, licenses, neardup, packing, pii, sstable, toxicity
from tests.llm.test_operators import EDGES

CLASH = ("spans", "items", "n", "score", "licence", "v", "id", "bin", "load", "kept", "component", "c", "x", "sketch", "_row", "_new0", "lang_pred", "row", "h", "family", "p")
ITEM = " ".join(f"q{k}" for k in range(12))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(3000)]
    long = " ".join(rng.choices(words, k=250_000))
    rows = [*EDGES, (5, "another text of the same id"), (5, None), (20, f"{long} {ITEM} a@b.cd"), (21, f"{long} {ITEM} a@b.cd"), (22, "x " * 200_000), (23, "\n" * 100_000), (24, "." * 300_000), (25, "7" * 200_000), (26, "é" * 200_000)]
    df = spark.createDataFrame([(d, t, "aa", 1 if t is None else len(t)) for d, t in rows], "doc_id long, text string, lang string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit(c) for c in CLASH}), sorted(str(d) for d, _ in rows)


def bench(spark):
    return spark.createDataFrame([("i", ITEM, 1), (None, None, 2), ("e", "", 3)], "item_id string, text string, spans int")


MODEL = langid.Model({"aa": ["alpha beta gamma word text"], "bb": ["delta epsilon"]})
PER_ROW = {
    "licences": lambda s, d: licenses.digest(d),
    "language": lambda s, d: langid.digest(d, MODEL),
    "decontamination": lambda s, d: decontam.digest(d, bench(s)),
    "near_duplicates": lambda s, d: neardup.near_duplicates(d, 4, 80),
    "toxicity": lambda s, d: toxicity.digest(d, toxicity.learn([], [])),
    "shards": lambda s, d: sstable.round_trip(d),
    "personal data": lambda s, d: pii.digest(d),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_for_each(spark, odd, name):
    df, want = odd
    got = PER_ROW[name](spark, df).collect()
    if name == "licences":  # equal ids are one document there: each of its rows tells all
        assert sorted({str(r.doc_id) for r in got}) == sorted(set(want))
    else:
        assert sorted(str(r.doc_id) for r in got) == want
    assert PER_ROW[name](spark, df.limit(0)).count() == 0


FILTERS = {
    "language": lambda s, d: langid.keep_identified(d, MODEL),
    "near_duplicates": lambda s, d: neardup.drop_near_duplicates(d, 4, 80),
    "decontamination": lambda s, d: decontam.decontaminate(d, bench(s)),
    "decontamination in blocks": lambda s, d: decontam.decontaminate(d, bench(s), block_bytes=1),
    "personal data": lambda s, d: pii.mask_personal_data(d),
}


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_filters_keep_all_columns(spark, odd, name):
    df, want = odd
    got = FILTERS[name](spark, df)
    assert got.columns == df.columns
    rows = got.collect()
    assert all(r[c] == c for r in rows for c in CLASH) and 5 < len(rows) <= len(want)
    long = [r for r in rows if r.doc_id in (20, 21)]
    assert long and all(len(r.text) > 1_000_000 and r.n_chars == len(r.text) for r in long)
    if "decontamination" in name:
        assert not any(ITEM in r.text for r in long)
    if name == "near_duplicates":
        assert [r.doc_id for r in long] == [20]
    assert FILTERS[name](spark, df.limit(0)).count() == 0


def test_packing_of_odd_tables(spark, odd):
    df, want = odd
    got = packing.packed(df).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= packing.CAPACITY and not got.duplicated(["sequence_id", "offset"]).any()
    assert sorted({"None" if d != d else str(int(d)) for d in got.doc_id}) == sorted(set(want))
    assert (got.piece == 0).sum() == len(want)


def test_empty_benchmarks(spark, odd):
    df, want = odd
    none = bench(spark).limit(0)
    assert decontam.digest(df, none).where("contaminated or n_items > 0").count() == 0
    assert decontam.decontaminate(df, none).count() == len(want)


def test_odd_tables_of_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", "<article><p>Text of it.</p>"), (None, None, ""), (2, "u", "<" * 200_000), (3, "u", "<p>" + "word " * 300_000)], "page_id long, url string, html string").withColumns({c: F.lit(c) for c in (*CLASH, "text")})
    got = htmltext.digest(pages).collect()
    assert sorted(str(r.page_id) for r in got) == ["1", "1", "2", "3", "None"] and max(r.n_chars for r in got) < 1_500_001
    vectors = spark.createDataFrame([(k % 50, [float(k % 7), 1.0, float(k)]) for k in range(120)] + [(0, None), (None, [1.0, 2.0, 3.0]), (40, [1.0])], "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in (*CLASH, "cell", "part", "block", "query_id")})
    found = ann.digest(vectors).toPandas()
    assert set(found.query_id) == {0, 20, 40} and (found.query_id != found.vec_id).all()
