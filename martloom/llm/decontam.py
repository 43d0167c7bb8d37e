"""Benchmark decontamination: a prefix-filtered set join of document words with item windows.

Shingles of up to four words stand for a window. For exact containment one shingle is the
necessary prefix: a document that holds a window holds its rarest shingle. So shingles are
ordered by how often the documents hold them, each window is indexed under its rarest one,
and document places join the index by that shingle only. Length and place bounds (the
window must begin and end inside the document around the shingle) and comparison of the
words themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import ALNUM, Words, fresh, grams, materialize, signed, slices, table

WINDOW = 13
SHINGLE = 4
#: Bits of a key that choose its bit in the sieve: 8 MB for a benchmark of any size.
SIEVE_BITS = 26

INDEX = "item_id string, len int, words string, shingles array<long>"
COUNTED = "key long, n long"
PLACES = "doc_id long, n_words long, places array<struct<key:long,pos:int,at:int,words:string>>"


def item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w = Words(part.column("text"), ALNUM, lower=True)
            h, raw, ids = w.hashes(), w.data(), part.column("item_id").to_pylist()
            out: list[tuple] = []
            for i, item in enumerate(ids):
                a, b = int(w.rows[i]), int(w.rows[i + 1])
                size = min(window, b - a)
                if not size:
                    continue
                keys = signed(grams(h[a:b], min(SHINGLE, size)))
                words = [raw[w.starts[k] : w.ends[k]].decode() for k in range(a, b)]
                span = size - min(SHINGLE, size) + 1
                out += [(item, size, " ".join(words[k : k + size]), keys[k : k + span].tolist()) for k in range(b - a - size + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], pa.list_(pa.int64()))], ["item_id", "len", "words", "shingles"])

    return run


class Sieve:
    """Lets pass all known keys, and of other keys as many as the share of bits that are set. The join with the index decides."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def places(self, keys: np.ndarray) -> np.ndarray:
        bit = keys.view(np.uint64) >> np.uint64(64 - SIEVE_BITS)
        return np.flatnonzero((self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))


def sieve_of(keys: DataFrame):
    """Broadcast of the bits of keys, put together by Spark: its size doesn't depend on their number."""
    bit = F.shiftrightunsigned("key", 64 - SIEVE_BITS)
    rows = keys.select(F.shiftright(bit, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    words = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(words)


def document_shingles(part: pa.RecordBatch, sizes: list[int], known: Sieve) -> tuple[Words, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The words of a slice and, for each shingle size, the places of shingles inside one document and their keys, those that pass the sieve."""
    w = Words(part.column("text"), ALNUM, lower=True)
    h, ends, out = w.hashes(), w.row_ends(), []
    for k in sizes:
        g = signed(grams(h, k))
        at = known.places(g)
        at = at[at + k <= ends[at]] if len(at) else at
        out.append((k, at, g[at]))
    return w, out


def shingle_counts(sizes: list[int], sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Sieve(sent.value)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def total() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([n for _, n in held]).astype(float)).astype(np.int64)

        for part in slices(batches):
            _, found = document_shingles(part, sizes, known)
            held += [np.unique(g, return_counts=True) for _, _, g in found if len(g)]
            if sum(len(k) for k, _ in held) > 1 << 21:
                keys, n = total()
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])
                held = []
        if held:
            keys, n = total()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    return run


def document_places(sizes: list[int], sent, window: int):
    """A row for each document: its words' number and the places of known shingles, each with the words around that a window there can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Sieve(sent.value)
        kind = pa.struct([("key", pa.int64()), ("pos", pa.int32()), ("at", pa.int32()), ("words", pa.string())])
        for part in slices(batches):
            w, found = document_shingles(part, sizes, known)
            raw, row_of = w.data(), np.repeat(np.arange(part.num_rows), w.counts())
            places: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for k, at, keys in found:
                for i, key in zip(at.tolist(), keys.tolist(), strict=True):
                    row = int(row_of[i])
                    a, b = int(w.rows[row]), int(w.rows[row + 1])
                    lo, hi = max(a, i - (window - k)), min(b, i + window)
                    words = b" ".join([raw[w.starts[j] : w.ends[j]] for j in range(lo, hi)]).decode()
                    places[row].append({"key": key, "pos": i - a, "at": i - lo, "words": words})
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(w.counts(), pa.int64()), pa.array(places, pa.list_(kind))], ["doc_id", "n_words", "places"])

    return run


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Occurrences of item windows: doc_id, n_words, n_hit, items (sorted array of item_id strings). One row a doc_id.

    Words are lower-cased (A-Z) runs of letters, digits and characters above 127. An item
    of fewer words than window is one window, one of none (or null) has none. A null or
    empty text has no words. Rows that share a doc_id are taken as parts of one document:
    their words add up, and hits count by place in their part, so repeated rows double
    both. Item ids that occur twice are one item. Empty tables give no rows, or no hits.
    Other columns are ignored.
    """
    wins = items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(item_windows(window), INDEX)
    wins = materialize(wins.groupBy("len", "words").agg(F.first("shingles").alias("shingles"), F.sort_array(F.collect_set("item_id")).alias("items")))
    sizes = sorted(min(SHINGLE, r[0]) for r in wins.select(F.least("len", F.lit(SHINGLE)).alias("k")).distinct().collect())
    sent = sieve_of(wins.select(F.explode("shingles").alias("key")))
    texts = docs.select("doc_id", "text")
    counts = texts.mapInArrow(shingle_counts(sizes, sent), COUNTED).groupBy("key").agg(F.sum("n").alias("n"))
    each = wins.select("len", "words", "items", F.posexplode("shingles").alias("off", "key")).join(counts, "key", "left")
    rarest = F.min_by(F.struct("key", "off"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "off"))
    index = materialize(each.groupBy("len", "words").agg(rarest.alias("p"), F.first("items").alias("items")).select(F.col("p.key").alias("_key"), F.col("p.off").alias("_off"), F.col("len").alias("_len"), F.col("words").alias("_words"), F.col("items").alias("_items")))
    sent = sieve_of(index.select(F.col("_key").alias("key")))
    found = texts.mapInArrow(document_places(sizes, sent, window), PLACES).withColumn("part", F.monotonically_increasing_id())
    found = found.select("doc_id", "part", "n_words", F.posexplode_outer("places").alias("nth", "x"))
    start = F.col("x.pos") - F.col("_off")
    inside = (start >= 0) & (start + F.col("_len") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("x.words", " "), F.col("x.at") - F.col("_off") + 1, F.col("_len")), " ") == F.col("_words")
    # A document without a place has no key; one of its own keeps all such from meeting in one task, and by chance met entries don't fit it.
    met = found.join(index, F.coalesce("x.key", F.xxhash64("part")) == F.col("_key"), "left")
    ok = F.coalesce(inside, F.lit(False)) & F.coalesce(F.when(inside, same), F.lit(False))
    span = F.when(ok, F.struct(start.alias("s"), (start + F.col("_len")).alias("e")))
    parts = met.groupBy("part", "doc_id").agg(F.max("n_words").alias("n_words"), F.sort_array(F.collect_set(span)).alias("spans"), F.array_distinct(F.flatten(F.collect_set(F.when(ok, F.col("_items"))))).alias("items"))
    hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")), lambda a, x: F.struct((a["n"] + F.greatest(x["e"] - F.greatest(x["s"], a["to"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["to"], x["e"]).alias("to")), lambda a: a["n"])
    return parts.withColumn("n_hit", hit).groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("n_hit").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """find() with contaminated: some word is hit and at least one in share of them."""
    found = find(docs, items, window)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns, whatever their names.

    Rows that share a doc_id, null included, are judged together and go together. Null and
    empty texts have no words and stay; without items all stay; an empty table stays empty.
    """
    key = fresh(docs, "bad")
    bad = judge(docs, items).filter("contaminated").select(F.col("doc_id").alias(key))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(key)), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM
        (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM
       (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
