"""Links of near duplicates from bands and texts made for the case, and recall on planted pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from martloom.llm import neardup

TEXT = "doc_id long, text string"


def alike(a: str, b: str) -> float:
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def linked(spark, bands: dict, texts: dict) -> set:
    found = neardup.links(spark.createDataFrame(list(bands.items()), "doc_id long, bands array<long>"), spark.createDataFrame(list(texts.items()), TEXT), 0.8, False)
    return {(r.a, r.b) for r in found.select("a", "b").collect()}


def words(n: int, other: int = 0, mark: str = "x") -> str:
    """n words; the last of them are others."""
    return " ".join([f"w{i}" for i in range(n - other)] + [f"{mark}{i}" for i in range(other)])


def test_members_that_fail_against_a_hub_find_each_other(spark):
    # All share band 1 with hub 9, which is like none of them; 1 and 2, 3 and 4 are alike.
    bands = {9: list(range(1, 60))} | {i: [1, 100 + i] for i in (1, 2, 3, 4)} | {i: [1, i] for i in range(10, 60)}
    texts = {i: words(60, 60, f"d{i}w") for i in bands} | {1: words(100), 2: words(100, 4), 3: words(90, 90, "y"), 4: words(90, 90, "y") + " z z"}
    assert linked(spark, bands, texts) == {(2, 1), (4, 3)}


def test_shingle_sets_decide(spark):
    texts = {1: words(100), 2: words(100, 14), 3: words(100, 100, "y"), 4: words(100, 100, "y") + " a b c d e"}
    assert alike(texts[1], texts[2]) < 0.8 <= alike(texts[3], texts[4])
    assert linked(spark, {i: [7] for i in texts}, texts) == {(4, 3)}


def test_prefix_filter_loses_no_pair(spark):
    rnd = random.Random(4)
    base, texts = [f"w{i}" for i in range(120)], {}
    for i in range(150):
        w = list(base[: rnd.randrange(60, 121)])
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(len(w))] = rnd.choice(["e1", "e2", f"own{i}"])
        texts[i] = " ".join(w)
    comp = {i: rnd.randrange(60) for i in texts}
    docs = spark.createDataFrame(list(texts.items()), TEXT)
    sets = docs.mapInArrow(neardup.shingle_sets(False), neardup.SETS)
    members = spark.createDataFrame(list(comp.items()), "doc_id long, comp long")
    got = {(r.a, r.b) for r in neardup.verified(neardup.across(members, sets, 0.8), sets, 0.8).collect()}
    assert got == {(a, b) for a in texts for b in range(a) if comp[a] != comp[b] and alike(texts[a], texts[b]) >= 0.8}


def test_bags(spark):
    texts = {1: "a b c d e f g " * 3, 2: "a b c d e f g " * 2, 3: "a b c d e f g " * 3 + "h"}
    docs = spark.createDataFrame(list(texts.items()), TEXT)
    sets = docs.mapInArrow(neardup.shingle_sets(True), neardup.SETS)
    pairs = spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "a long, b long")
    assert [(r.a, r.b) for r in neardup.verified(pairs, sets, 0.8).collect()] == [(3, 1)]


@pytest.mark.parametrize("size, edits", [(60, 1), (110, 2), (200, 4)])
def test_recall_of_planted_pairs(spark, size, edits):
    """Pairs that are 0.8 to 0.85 alike: each document has a copy with some words changed."""
    rnd = random.Random(edits)
    rows, planted = [], []
    for i in range(400):
        w = [f"v{rnd.randrange(5000)}" for _ in range(size)]
        c = list(w)
        for at in rnd.sample(range(size), edits):
            c[at] = f"n{rnd.randrange(10**6)}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(c))]
        if alike(rows[-2][1], rows[-1][1]) >= 0.8:
            planted.append(i)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(rows, TEXT)).collect()}
    found = sum(got[2 * i] == got[2 * i + 1] for i in planted)
    assert len(planted) > 100 and found >= 0.99 * len(planted)
    assert all(got[2 * i] == 2 * i and got[2 * i + 1] in (2 * i, 2 * i + 1) for i in range(400))


def test_deduplicated_keeps_what_has_no_class(spark):
    rows = [(1, words(50), 0), (2, words(50), 1), (None, words(50), 2), (None, None, 3), (4, None, 4), (5, "", 5), (7, words(9, 9, "q"), 6), (7, words(9, 9, "q"), 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int").withColumn("_id", F.lit(1)).withColumn("class_id", F.lit("c"))
    got = neardup.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.kept) for r in got.collect()) == [(0, 2), (0, 3), (1, 0), (4, 4), (5, 5), (7, 6)]
    assert neardup.deduplicated(docs.limit(0)).count() == 0
