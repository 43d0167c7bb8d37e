import pytest

from martloom.llm import mixing


def filled(sizes: list[int], weights: list[int], epochs: int) -> list[float]:
    """Targets by clamping and sharing again until none is above its cap."""
    total, target = float(sum(sizes)), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in target]
        left = total - sum(target.values())
        shares = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if shares[i] > epochs * sizes[i]]
        if not over:
            return [target.get(i, shares.get(i)) for i in range(len(sizes))]
        target |= {i: float(epochs * sizes[i]) for i in over}


@pytest.fixture(scope="module")
def docs(spark):
    sizes = {"a": [1] * 3, "b": [400, 300, 200, 100], "c": [7, 0, 3], None: [50, 50], "d": [900] * 3, "e": [0], "f": [2] * 40}
    rows = [(100 * k + i, "w " * n if n else None, s, 1.0) for k, (s, ns) in enumerate(sizes.items()) for i, n in enumerate(ns)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target double")


def test_targets_and_taken_words(docs):
    rows = mixing.mix_plan(docs).collect()
    sources = sorted({r.source for r in rows if r.source}) + [None]
    sizes = [next(r.source_size for r in rows if r.source == s) for s in sources]
    want = filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 3)
    for s, size, t in zip(sources, sizes, want, strict=True):
        mine = [r for r in rows if r.source == s]
        assert all(r.target == pytest.approx(t) for r in mine)
        assert abs(sum(r.taken for r in mine) - t) <= max(r.size for r in mine) / 2 + 1e-6
    assert sum(want) == pytest.approx(sum(sizes))
    assert all(0 <= r.taken <= 3 * r.size for r in rows)


def test_reruns_agree_and_rows_repeat(docs):
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect()}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    got = {r[0]: r[1] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in plan.items() if v}


def test_empty(docs):
    assert mixing.mix_plan(docs.limit(0)).count() == 0
