"""Language ID by string kernels: n-gram presence, Nystroem landmarks, one-versus-rest kernel ridge regression.

The kernel of two texts is a blend over n of the n-grams (bytes of lower-cased letters, all
else one blank) that both hold, divided by the root of how many each holds. Landmarks are
texts of each language; the n-grams that at least two of them hold are the kernel's
alphabet, so that a text is a row of presence bits. Training texts' kernels against the
landmarks, whitened, give features whose products Spark adds up from all tasks; one ridge
system of the landmarks' number gives the coefficients of all languages. A text's scores are
presence bits times the product of the landmarks' bits with those coefficients: batches of
matrix products, with no kernel row in between, since products can be taken in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.llm.common import LOWER, materialize, slices, table, text_bytes

#: Lengths of n-grams, in bytes, and their parts in the blend.
BLEND = {1: 0.1, 2: 0.2, 3: 0.3, 4: 0.4}
#: Different texts of each language that are landmarks, and that are trained on: the bounds of the sample.
LANDMARKS, TRAINED = 48, 400
RIDGE = 1e-3
#: Presence bits of a batch of texts, and bytes of a text that are looked at together.
BATCH_BITS, STRETCH = 1 << 24, 1 << 19
UNKNOWN = "und"

LETTER = np.zeros(256, np.uint8)
LETTER[97:123] = np.arange(97, 123)
LETTER[128:] = np.arange(128, 256)

GRAMS = "lang string, grams array<long>"
PRODUCTS = "i int, row binary"
PREDICTED = "doc_id long, lang_pred string, score double"


def letters(raw: np.ndarray) -> np.ndarray:
    """Lower-cased letters with one blank (0) for each stretch of anything else, and before and after all."""
    code = LETTER[LOWER[raw]]
    code = np.concatenate([np.zeros(1, np.uint8), code, np.zeros(1, np.uint8)])
    return code[np.append(True, (code[1:] > 0) | (code[:-1] > 0))]


def n_grams(code: np.ndarray, n: int) -> np.ndarray:
    """The n-grams of a text as numbers, n in the top byte."""
    if len(code) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(code) - n + 1, n << 56, np.uint64)
    for j in range(n):
        out |= code[j : j + len(out)].astype(np.uint64) << np.uint64(8 * j)
    return out


def stretches(raw: np.ndarray) -> Iterator[np.ndarray]:
    """The letters of a text in stretches that share an n-gram's length, so that none is lost in between."""
    for at in range(0, max(len(raw), 1), STRETCH):
        yield letters(raw[max(0, at - max(BLEND)) : at + STRETCH])


def gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        raw, at = text_bytes(part.column("text"))
        sets = []
        for a, z in zip(at, at[1:], strict=False):
            found = [np.unique(np.concatenate([n_grams(code, n) for n in BLEND])) for code in stretches(raw[a:z])]
            sets.append(np.unique(np.concatenate(found)).astype(np.int64))
        yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(sets, pa.list_(pa.int64()))], ["lang", "grams"])


class Alphabet:
    """Numbers of the n-grams of the kernel, by a table of their hashes in which each is looked up and compared."""

    def __init__(self, grams: np.ndarray) -> None:
        self.grams = grams.astype(np.uint64)
        self.size = len(grams)
        self.order = (self.grams >> np.uint64(56)).astype(np.int64)
        self.bits = max(10, int(4 * self.size).bit_length())
        self.table = np.full(1 << self.bits, -1, np.int32)
        at = self._place(self.grams)
        self.table[at] = np.arange(self.size)
        self.lost = np.sort(self.grams[self.table[at] != np.arange(self.size)])  # of those that share a place the last has it
        self.lost_ids = np.searchsorted(self.grams, self.lost)

    def _place(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Numbers of those of the n-grams that are in the alphabet, repeats included. The alphabet is sorted."""
        if not self.size:
            return np.zeros(0, np.int64)
        got = self.table[self._place(grams)]
        hit = got >= 0
        same = self.grams[np.where(hit, got, 0)] == grams
        out = got[hit & same].astype(np.int64)
        if len(self.lost):
            rest = grams[hit & ~same]
            where = np.minimum(np.searchsorted(self.lost, rest), len(self.lost) - 1)
            out = np.concatenate([out, self.lost_ids[where[self.lost[where] == rest]]])
        return out

    def present(self, raw: np.ndarray, row: np.ndarray) -> None:
        """Sets the bits of a text's n-grams in row."""
        for code in stretches(raw):
            for n in BLEND:
                row[self.find(n_grams(code, n))] = 1

    def scales(self, bits: np.ndarray) -> dict[int, np.ndarray]:
        """For each length, the root of its part in the blend over the root of the number of n-grams that each text holds."""
        out = {}
        for n, part in BLEND.items():
            held = bits[:, self.order == n].sum(1)
            out[n] = np.sqrt(part) / np.sqrt(np.maximum(held, 1)).astype(np.float32)
        return out

    def scaled(self, bits: np.ndarray) -> np.ndarray:
        """Rows whose products are the kernel."""
        out = bits.astype(np.float32)
        for n, s in self.scales(bits).items():
            out[:, self.order == n] *= s[:, None]
        return out

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Texts with their presence bits, as many at once as BATCH_BITS allow."""
        step = max(1, BATCH_BITS // max(self.size, 1))
        for part in slices(batches):
            for first in range(0, part.num_rows, step):
                some = part.slice(first, step)
                raw, at = text_bytes(some.column("text"))
                bits = np.zeros((some.num_rows, self.size), np.float32)
                for row, a, z in zip(bits, at, at[1:], strict=False):
                    self.present(raw[a:z], row)
                yield some, bits


def products(sent):
    """Of a task's training texts: the rows of F'F and F'Y, F the texts' features and Y one column a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, landmarks, whiten, langs = sent.value
        total = np.zeros((len(whiten) + 1, len(whiten) + 1 + len(langs)))
        for part, bits in alphabet.batches(batches):
            features = np.hstack([alphabet.scaled(bits) @ landmarks.T @ whiten, np.ones((len(bits), 1), np.float32)])
            y = np.array([[x == lang for lang in langs] for x in part.column("lang").to_pylist()], np.float64).reshape(-1, len(langs))
            total += features.T.astype(np.float64) @ np.hstack([features, y])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    return run


def added(t: pa.Table) -> pa.Table:
    row = sum(np.frombuffer(x, np.float64) for x in t.column("row").to_pylist())
    return pa.table([t.column("i").slice(0, 1), pa.array([row.tobytes()], pa.binary())], ["i", "row"])


class Model:
    """langs, and for each n-gram and language the weight that a text's scaled bit has; intercepts."""

    def __init__(self, langs: list[str], alphabet: Alphabet, weights: np.ndarray, intercepts: np.ndarray) -> None:
        self.langs, self.alphabet, self.weights, self.intercepts = langs, alphabet, weights.astype(np.float32), intercepts

    def scores(self, bits: np.ndarray) -> np.ndarray:
        out = np.tile(self.intercepts, (len(bits), 1))
        for n, s in self.alphabet.scales(bits).items():
            which = self.alphabet.order == n
            out += (bits[:, which] @ self.weights[which]) * s[:, None]
        return out


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def fit(docs: DataFrame, landmarks: int = LANDMARKS, trained: int = TRAINED, ridge: float = RIDGE):
    """A broadcast Model from the rows of docs (doc_id, lang, text) with a lang and a text that has a letter.

    Of each language at most trained different texts are used, whole, those that come first
    by a hash of the text; the first landmarks of them are landmarks too. Copies count once.
    Only landmarks' n-grams and products of features come to the driver. Without any row the
    model has no languages.
    """
    spark = docs.sparkSession
    known = docs.select("doc_id", "lang", "text").filter("lang is not null and text is not null").filter(F.col("text").rlike(r"\p{L}"))
    known = known.withColumn("h", F.xxhash64("text"))
    # A share of the hashes that holds twice as many different texts as are wanted of a language, whatever its size.
    share = F.least(F.lit(1.0), 2.0 * trained / F.approx_count_distinct("h")).alias("share")
    low = known.join(materialize(known.groupBy("lang").agg(share)), "lang").filter(F.shiftrightunsigned("h", 11) < F.col("share") * F.lit(float(1 << 53)))
    first = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11), "h")
    chosen = low.groupBy("lang", "h").agg(F.min("doc_id").alias("id")).withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= trained)
    chosen = materialize(chosen)  # of copies one row, so that no text is shuffled as often as it occurs
    sample = known.join(chosen, ["lang", "h"]).filter(F.col("doc_id").eqNullSafe(F.col("id")))
    sample = materialize(sample.groupBy("lang", "h", "nth").agg(F.min("text").alias("text")))
    held = sample.filter(F.col("nth") <= landmarks).orderBy("lang", "nth").select("lang", "text").mapInArrow(gram_sets, GRAMS).toArrow()
    langs = sorted(set(held.column("lang").to_pylist()))
    if not langs:
        return spark.sparkContext.broadcast(Model([], Alphabet(np.zeros(0, np.uint64)), np.zeros((0, 0)), np.zeros(0)))
    sets = [np.asarray(x, np.int64) for x in held.column("grams").to_pylist()]
    grams, seen = np.unique(np.concatenate(sets), return_counts=True)
    alphabet = Alphabet(grams[seen >= min(2, len(sets))])
    bits = np.zeros((len(sets), alphabet.size), np.float32)
    for row, x in zip(bits, sets, strict=True):
        row[alphabet.find(x.astype(np.uint64))] = 1
    rows = alphabet.scaled(bits)
    values, vectors = np.linalg.eigh((rows @ rows.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
    sent = spark.sparkContext.broadcast((alphabet, rows, whiten, langs))
    total = sample.select("lang", "text").mapInArrow(products(sent), PRODUCTS).groupBy("i").applyInArrow(added, PRODUCTS).toArrow().sort_by("i")
    total = np.array([np.frombuffer(x, np.float64) for x in total.column("row").to_pylist()])
    n = len(total)
    n_texts = total[n - 1, n - 1]
    penalty = ridge * n_texts * np.append(np.ones(n - 1), 1e-9)
    beta = np.linalg.solve(total[:, :n] + np.diag(penalty), total[:, n:])
    return spark.sparkContext.broadcast(Model(langs, alphabet, rows.T @ (whiten @ beta[:-1]), beta[-1]))


def predicted(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for part, bits in model.alphabet.batches(batches):
            letter = part.column("letter").to_numpy(zero_copy_only=False).astype(bool)
            if model.langs:
                scores = model.scores(bits)
                best = scores.argmax(1)
                names = [model.langs[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), letter.tolist(), strict=True)]
                score = np.where(letter, np.clip(scores[np.arange(len(best)), best], 0, 1), 0.0)
            else:
                names, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of each text.

    A null text, an empty one or one without any letter is `und` with score 0, and so is any
    text if the model has no languages. A text with letters but none of the model's n-grams
    gets the language that was learnt with the largest intercept. Rows that share a doc_id,
    null included, are predicted each for itself; an empty table gives no rows; other columns
    are ignored.
    """
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letter.alias("letter")).mapInArrow(predicted(model), PREDICTED)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(remainder(F.col("doc_id")) != 2))
    found = predict(docs, model)
    return found.withColumn("held_out", remainder(F.col("doc_id")) == 2).select("doc_id", "held_out", "lang_pred", "score")
