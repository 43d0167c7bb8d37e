"""Toxicity scores and located sentences recomputed plainly from the model's weights."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from martloom.llm import toxicity

RND = random.Random(21)
WORDS = ["calm", "Viler", "vile", "tree", "böse", "x", "stupider", "12", "_", "ok"]


def plain(model: tuple, text: str | None, limit: float) -> tuple[float, list[tuple]]:
    """Every word of every sentence, one after the other: P = 1 - (1 - background) times the product of (1 - p) of the sentences."""
    weights, bias, background = model
    clean, spans, words = math.exp(-background), [], []

    def end() -> None:
        nonlocal clean
        if words:
            z = bias + sum(float(weights[f]) for w, _, _ in words for f in toxicity.features(w))
            p = 1 / (1 + math.exp(-z))
            clean *= 1 - p
            if p >= limit:
                spans.append((words[0][1], words[-1][2], p))
            words.clear()

    for m in toxicity.TOKEN.finditer(text or ""):
        if m[0] in ".!?\n":
            end()
        else:
            words.append((m[0], m.start(), m.end()))
    end()
    return 1 - clean, spans


def test_scores_and_sentences_equal_the_plain_sums(spark):
    weights = np.zeros(toxicity.BUCKETS, np.float32)
    for word, w in (("vile", 4.0), ("stupider", 2.5), ("böse", 6.0)):
        weights[toxicity.features(word)] = w / 2
    weights[0] = 0.0
    model = (weights, -3.0, 0.02)
    texts = [None, "", " .. !", "vile", "calm tree. VILE böse! ok?\n x", "😀 vile. 😀😀 böse", "no end", "stupider stupider\nstupider."]
    texts += ["".join(RND.choice(WORDS) + RND.choice([" ", " ", ". ", "! ", "\n"]) for _ in range(RND.randrange(1, 80))) for _ in range(60)]
    texts.append("calm " * 150_000 + ". vile böse. " + "tree. " * 50_000)
    docs = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, score string, sentences int").repartition(3)
    sent = spark.sparkContext.broadcast(model)
    got = {r.doc_id: r for r in toxicity.score(docs, sent, locate=0.5).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        score, spans = plain(model, text, 0.5)
        r = got[i if i else None]
        assert r.score == pytest.approx(score, abs=1e-6), i
        want = spans if score >= 0.5 else []
        assert [(s.start, s.end) for s in r.sentences] == [s[:2] for s in want], i
        assert [s.score for s in r.sentences] == pytest.approx([s[2] for s in want], abs=1e-6)
    assert {r.doc_id: r.score for r in toxicity.score(docs, sent).collect()} == pytest.approx({k: r.score for k, r in got.items()})
