"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels.

A sentence's logit is a bias plus a weight, never below 0, for each hashed feature of its
words (the word and its first letters), so that clean words don't outvote an insult. The
weights' sum is penalised, which leaves most at 0. A document is toxic unless every sentence, and a background that
stands for wrong labels, is not: P = 1 - exp(-(background + sum of softplus(logit))).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import fresh, materialize, slices, table

BUCKETS = 1 << 20
PREFIXES = (3, 4, 5, 6, 7)
TOKEN = re.compile(r"\w+|[.!?\n]")
ENDS = frozenset(".!?\n")
SAMPLE_DOCS = 5000
SAMPLE_CHARS = 100_000
CACHE = 200_000


def features(word: str) -> list[int]:
    """Buckets of a word and its first letters; bucket 0 stands for those it hasn't."""
    word = word.lower()
    known = [xxhash.xxh32_intdigest(f"{k}^{word[:k]}") % (BUCKETS - 1) + 1 if len(word) > k else 0 for k in PREFIXES]
    return [xxhash.xxh32_intdigest("=" + word) % (BUCKETS - 1) + 1, *known]


class Memo(dict):
    """What a word maps to, worked out once; an end of sentence maps to None."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, token: str):
        self[token] = value = None if token in ENDS else self.make(token)
        return value


def instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A labelled document's words as feature buckets, and how many words each sentence has."""
    memo = Memo(features)
    for part in slices(batches):
        words, sizes = [], []
        for text in part.column("text").to_pylist():
            row, n, out = [], [], 0
            for f in map(memo.__getitem__, TOKEN.findall(text or "")):
                if f is not None:
                    row.append(f)
                    out += 1
                elif out:
                    n.append(out)
                    out = 0
            if out:
                n.append(out)
            words.append(np.array(row, np.uint32).tobytes())
            sizes.append(np.array(n, np.uint32).tobytes())
        if len(memo) > CACHE:
            memo.clear()
        yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), pa.array(words, pa.binary()), pa.array(sizes, pa.binary())], ["toxic", "words", "sizes"])


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def train(rows: list[tuple[int, bytes, bytes]], rounds: int = 140, rate: float = 0.15, decay: float = 0.05, lasso: float = 0.5) -> tuple[np.ndarray, float, float]:
    """Weights, bias and background that fit the labels best, by Adam over all rows, with weights brought back to 0 from below after each step. Without rows of both kinds: no weights, and the labels' share as background."""
    y = np.array([r[0] for r in rows], np.float64)
    weights = np.zeros(BUCKETS, np.float32)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return weights, -20.0, float(-np.log(max(1 - share, 1e-6)))
    sizes = [np.frombuffer(r[2], np.uint32) for r in rows]
    words = np.frombuffer(b"".join(r[1] for r in rows), np.uint32).reshape(-1, 1 + len(PREFIXES))
    rows.clear()
    name = words[:, 0].astype(np.uint64)  # the word's own bucket and two of its prefixes' tell words apart
    for column in (-1, 1):
        name = (name << np.uint64(20)) | words[:, column]
    _, first, word = np.unique(name, return_index=True, return_inverse=True)
    kinds, word = words[first], word.astype(np.int32)
    del words, name
    sentence = np.repeat(np.arange(sum(map(len, sizes)), dtype=np.int32), np.concatenate(sizes))
    doc = np.repeat(np.arange(len(y)), list(map(len, sizes)))
    used, local = np.unique(kinds, return_inverse=True)
    local = local.reshape(kinds.shape)
    theta = np.zeros(len(used) + 2)
    theta[-2:] = -6.0, -4.0
    live = (used != 0).astype(float)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w = theta[:-2] * live
        z = np.bincount(sentence, w[local].sum(1)[word], len(doc)) + theta[-2]
        total = np.bincount(doc, softplus(z), len(y)) + softplus(theta[-1:])[0]
        d_total = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0) / len(y)
        d_z = d_total[doc] / (1 + np.exp(-np.maximum(z, -500)))
        d_word = np.bincount(word, d_z[sentence], len(kinds))
        grad = np.empty_like(theta)
        grad[:-2] = np.bincount(local.reshape(-1), np.repeat(d_word, local.shape[1]), len(used)) * live + (decay * w + lasso * (w > 0)) / len(y)
        grad[-2] = d_z.sum()
        grad[-1] = d_total.sum() / (1 + np.exp(-theta[-1]))
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        np.maximum(theta[:-2], 0, out=theta[:-2])
    weights[used] = theta[:-2] * live
    return weights, float(theta[-2]), float(softplus(theta[-1:])[0])


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS):
    """The model, from at most sample_docs labelled documents of at most sample_chars characters outside the held-out fifth, the first by a hash of doc_id.

    Of labels that disagree the larger counts; null labels and ids don't. Without labels of both kinds every text gets the same score.
    """
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("_id is not null and toxic is not null").filter(remainder(F.col("_id")) != 0)
    known = docs.filter(F.coalesce(F.length("text"), F.lit(0)) <= sample_chars).select("doc_id").filter(remainder(F.col("doc_id")) != 0).distinct()
    chosen = usable.groupBy("_id").agg(F.max("toxic").alias("toxic")).join(known, F.col("_id") == F.col("doc_id"), "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
    chosen = materialize(chosen)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic")
    got = rows.mapInArrow(instances, "toxic int, words binary, sizes binary").toLocalIterator()
    return spark.sparkContext.broadcast(train(sorted((r[0], bytes(r[1]), bytes(r[2])) for r in got)))


def scored(model, locate: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, background = model.value
        memo = Memo(lambda w: float(weights[features(w)].sum()))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        nan = float("nan")
        for part in slices(batches):
            scores, spans = [], []
            for text in part.column("text").to_pylist():
                text = text or ""
                v = np.array([nan if x is None else x for x in map(memo.__getitem__, TOKEN.findall(text))], np.float64)
                cut = np.isnan(v)
                which = np.cumsum(cut)[~cut]
                z, has = np.bincount(which, v[~cut]), np.bincount(which) > 0
                z = z[has] + bias
                score = float(-np.expm1(-(background + softplus(z).sum())))
                scores.append(score)
                if locate is not None:
                    spans.append(sentences(text, z, locate) if score >= locate else [])
            if len(memo) > CACHE:
                memo.clear()
            out = [part.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(spans, kind)] if locate is not None else []), ["doc_id", "score", "sentences"][: 2 + (locate is not None)])

    return run


def sentences(text: str, z: np.ndarray, limit: float) -> list[dict]:
    """Places, in code points of the text, of the sentences that score limit or more, from first to last word."""
    out, first, last, k = [], None, 0, 0
    for m in [*TOKEN.finditer(text), None]:
        if m is not None and m[0] not in ENDS:
            first, last = m.start() if first is None else first, m.end()
        elif first is not None:
            p = 1 / (1 + np.exp(-z[k]))
            if p >= limit:
                out.append({"start": first, "end": last, "score": float(p)})
            first, k = None, k + 1
    return out


def score(docs: DataFrame, model, locate: float | None = None) -> DataFrame:
    """doc_id and score of each document; with locate also its sentences that score that or more.

    A null or empty text has no sentences: its score is the background's. Rows that share a
    doc_id are scored each for itself, an empty table gives no rows, other columns are ignored.
    """
    schema = "doc_id long, score double" + (", sentences array<struct<start:int,end:int,score:double>>" if locate is not None else "")
    return docs.select("doc_id", "text").mapInArrow(scored(model, locate), schema)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score less than threshold, with all their columns, whatever their names.

    Of rows that share a doc_id, null included, all go if one does. Null and empty texts
    get the background's score and stay. Without labels all stay. An empty table stays empty.
    """
    key = fresh(docs, "bad")
    bad = score(docs, fit(docs, labels)).filter(F.col("score") >= threshold).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(key)), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")), locate=0.5)
    return found.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")
