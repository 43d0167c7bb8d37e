"""Near duplicates by DartMinHash signatures and banded joining.

An element of weight x throws darts at its own plane of weight and rank: a seeded Poisson
process of intensity one, cut by weight into the regions [0, 1), [1, 2), [2, 4), ... A dart
counts if its weight lies below x and its rank below the document's bound, which is set so
that about k ln k + 2 k darts count whatever the document's size. Each dart has one of k
coordinates, and the dart of least rank is the signature there. Two documents agree at a
coordinate with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import ALNUM, Words, fresh, grams, materialize, mix, signed, slices, table

ROWS, BANDS = 5, 24
K = ROWS * BANDS
SHINGLE = 5
GOLD = 0x9E3779B97F4A7C15

SIGNED = "doc_id long, n long, set1 long, set2 long, bands array<long>"
SETS = "_id long, n int, set array<long>"
#: Bits of an id's hash that choose its bit in a sieve.
SIEVE_BITS = 26
#: Steps of set sizes, as a factor, by which prefix entries are dealt.
STEP = 1.02


def uniform(seed: np.ndarray) -> np.ndarray:
    """(0, 1] from hashes."""
    return ((mix(seed.copy()) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_rows: int, k: int = K) -> np.ndarray:
    """k hashes for each row that has elements, zeros for the others. rows: an element's row, ascending."""
    out = np.zeros((n_rows, k), np.uint64)
    mass = np.bincount(rows, weights, n_rows)
    darts = k * np.log(k) + 2 * k
    todo = mass > 0
    while todo.any():
        bound = np.where(todo, darts / np.where(mass > 0, mass, 1), 0.0)
        got_row, got_rank, got_dart = [], [], []
        low, width, level = 0.0, 1.0, 0
        at = np.flatnonzero(todo[rows])
        while len(at):
            alive, rank, j = at, np.zeros(len(at)), 0
            while len(alive):
                j += 1
                seed = elements[alive] + np.uint64((GOLD * (j + (level << 40))) % (1 << 64))
                rank = rank - np.log(uniform(seed)) / width
                keep = rank < bound[rows[alive]]
                alive, rank, seed = alive[keep], rank[keep], seed[keep]
                hit = low + width * uniform(seed ^ np.uint64(GOLD)) < weights[alive]
                got_row.append(rows[alive[hit]])
                got_rank.append(rank[hit])
                got_dart.append(mix(seed[hit] ^ np.uint64(0x5851F42D4C957F2D)))
            low, width, level = (1.0, 1.0, 1) if level == 0 else (2 * low, 2 * width, level + 1)
            at = at[weights[at] > low]
        row, rank, dart = map(np.concatenate, (got_row, got_rank, got_dart))
        place = row * k + (dart % np.uint64(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        filled = np.zeros(n_rows * k, bool)
        filled[place] = True
        flat = np.zeros(n_rows * k, np.uint64)
        flat[place[order]] = dart[order]
        done = todo & filled.reshape(n_rows, k).all(1)
        out[done] = flat.reshape(n_rows, k)[done]
        todo &= ~done
        darts *= 2
    return out


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and number of each different shingle, by row and hash. A text of fewer words, but not none, has one shingle of all."""
    w = Words(column, ALNUM, lower=True)
    h, n = w.hashes(), w.counts()
    g = grams(h, size)
    at = np.flatnonzero(np.arange(len(g)) + size <= w.row_ends()[: len(g)]) if len(g) else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(n)), n)[at]
    g = g[at]
    for i in np.flatnonzero((n > 0) & (n < size)):
        rows, g = np.append(rows, i), np.append(g, grams(h[w.rows[i] : w.rows[i + 1]], int(n[i])))
    order = np.lexsort((g, rows))
    rows, g = rows[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (g[1:] != g[:-1])
    first = np.flatnonzero(new)
    return rows[first], g[first], np.diff(np.append(first, len(g)))


def banded(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """Hashes of groups of coordinates."""
    factor = np.array([pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64) for i in range(rows)], np.uint64)
    sums = (sig[:, : bands * rows].astype(np.uint64).reshape(len(sig), bands, rows) * factor).sum(2, dtype=np.uint64)
    return signed(mix(sums + (np.arange(bands, dtype=np.uint64) + np.uint64(rows << 16)) * np.uint64(GOLD)))


def sketch(weighted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows, g, count = shingles(part.column("text"))
            total = part.num_rows
            weights = count.astype(np.float64) if weighted else np.ones(len(g))
            n = np.bincount(rows, minlength=total)
            sets = []
            for salt in (1, 2):
                sums = np.zeros(len(g) + 1, np.uint64)
                np.cumsum(mix(g + np.uint64(GOLD * salt % (1 << 64))) * (count.astype(np.uint64) if weighted else np.uint64(1)), out=sums[1:])
                ends = np.cumsum(n)
                sets.append(signed(sums[ends] - sums[ends - n]))
            bands = banded(signatures(rows, g, weights, total), ROWS, BANDS)
            lists = [bands[i].tolist() if n[i] else [] for i in range(total)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sets[0]), pa.array(sets[1]), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "n", "set1", "set2", "bands"])

    return run


class Sieve:
    """A table of bits of fixed size: lets pass all ids that it was made of, and of others as many as the share of bits that are set."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def passes(self, ids: np.ndarray) -> np.ndarray:
        bit = mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - SIEVE_BITS)
        return ((self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)


def sieve_of(ids: DataFrame):
    """Broadcast of the bits of a column _w of ids, put together by Spark: 8 MB, however many they are."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = mix(batch.column("_w").to_numpy().view(np.uint64)) >> np.uint64(64 - SIEVE_BITS)
            word, at = np.unique(bit >> np.uint64(6), return_inverse=True)
            out = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(out, at, np.uint64(1) << (bit & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(signed(word)), pa.array(signed(out))], ["word", "bits"])

    rows = ids.mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (SIEVE_BITS - 6), np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return ids.sparkSession.sparkContext.broadcast(words)


def shingle_sets(weighted: bool, sent=None):
    """The shingles of each text, of those that pass the sieve if one is sent; with weighted the k-th occurrence of a shingle is an element of its own, so that bags compare as sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            if sent:
                part = part.filter(pa.array(Sieve(sent.value).passes(part.column("doc_id").to_numpy())))
            rows, g, count = shingles(part.column("text"))
            if weighted:
                nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                rows, g = np.repeat(rows, count), mix(np.repeat(g, count) + nth.astype(np.uint64) * np.uint64(GOLD))
            n = np.bincount(rows, minlength=part.num_rows)
            sets = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(signed(g)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int32()), sets], ["_id", "n", "set"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are alike at the threshold or more: every pair's sets are compared. b should have fewer different ids, as hubs have."""
    side = lambda name: sets.select(F.col("_id").alias(f"_{name}"), F.col("n").alias(f"n_{name}"), F.col("set").alias(f"set_{name}"))
    few = side("b").join(pairs.select(F.col("b").alias("_few")).distinct(), F.col("_b") == F.col("_few"), "left_semi")
    both = pairs.join(side("a"), F.col("a") == F.col("_a")).join(few, F.col("b") == F.col("_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter((1 + threshold) * common >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-9).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that can be reached. Labels pass along links and then through each label's own label, until none changes."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        named = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        best = edges.join(named, F.col("b") == F.col("_n")).groupBy(F.col("a").alias("_a")).agg(F.min("_l").alias("_best"))
        passed = labels.join(best, F.col("node") == F.col("_a")).select("node", F.col("label").alias("was"), F.least("label", "_best").alias("label"))
        jumped = passed.join(named, F.col("label") == F.col("_n"), "left").select("node", "was", F.least("label", F.coalesce("_l", "label")).alias("label"))
        labels = materialize(jumped)
        if not labels.filter("label <> was").limit(1).count():
            return labels.select("node", "label")


def size_step(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(STEP)).cast("int")


def across(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a > b, of documents of different parts that can be alike, by a prefix filter over their shingle sets. members: doc_id, comp.

    Only shingles that more than one part holds can be common to a pair. A set's elements
    are ordered, those that no other part holds first, then rare ones first; sets that are
    alike at the threshold have a common element among the first n - t n + 1 of each, and
    what follows the first common one bounds the sizes of both: the partner of an element at
    place pos has at most (1 + t) / t (n - pos) - n elements. Entries of the smaller set are
    dealt by element and size, those of the larger one to each size that its bounds allow,
    so that copies which all fail against their original, each by edits of its own, don't meet.
    """
    t = threshold
    each = members.join(sets, F.col("doc_id") == F.col("_id")).select("doc_id", "comp", "n", F.explode("set").alias("token"))
    held = each.groupBy(F.col("token").alias("_t")).agg(F.min("comp").alias("_from"), F.max("comp").alias("_to"), F.count("*").alias("_docs")).filter("_from < _to")
    shared = each.join(held, F.col("token") == F.col("_t")).groupBy("doc_id", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("_docs", "token"))).alias("shared"))
    own = F.col("n") - F.size("shared")
    room = (F.col("n") - F.ceil(t * F.col("n") - 1e-9) + 1 - own).cast("int")
    first = shared.filter(room > 0).select("doc_id", "comp", "n", own.alias("own"), F.posexplode(F.slice("shared", F.lit(1), room)).alias("nth", "x"))
    most = F.floor((1 + t) / t * (F.col("n") - F.col("own") - F.col("nth")) - F.col("n") + 1e-9).cast("int")
    least = F.ceil(t * F.col("n") - 1e-9).cast("int")
    entries = materialize(first.select("doc_id", "comp", "n", F.col("x.token").alias("token"), most.alias("most"), least.alias("least")).filter("most >= least"))
    small = entries.filter("most >= n").select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "comp", "n", "token", "most")], size_step(F.col("n")).alias("_step"))
    large = entries.withColumn("step", F.explode(F.sequence(size_step(F.col("least")), size_step(F.least("n", "most")))))
    fits = (F.col("_n") >= F.col("least")) & (F.col("_n") <= F.least("n", "most")) & (F.col("n") <= F.col("_most")) & (F.col("comp") != F.col("_comp")) & ((F.col("_n") < F.col("n")) | (F.col("_doc_id") < F.col("doc_id")))
    met = large.join(small, (F.col("token") == F.col("_token")) & (F.col("step") == F.col("_step")) & fits)
    return met.select(F.greatest("doc_id", "_doc_id").alias("a"), F.least("doc_id", "_doc_id").alias("b")).distinct()


def links(sketches: DataFrame, docs: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """Verified links (a, b), a > b, that join all documents of a near-duplicate class.

    Documents that share a band of five coordinates form a bucket. Its hub is the member
    whose bands meet most others, as the original of edited copies does, and each member is
    compared with it: n comparisons for n members. The members of buckets that stay in more
    than one part then meet members of other parts by a prefix filter, which loses no pair
    of the threshold. Shingle sets decide on every candidate; links inside a part that is
    already joined aren't looked for.
    """
    members = materialize(sketches.select("doc_id", F.explode("bands").alias("band")).distinct())
    shared = members.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    members = members.join(shared, "band")
    centre = members.groupBy(F.col("doc_id").alias("_id")).agg(F.sum("size").alias("rank"))
    members = materialize(members.join(centre, F.col("doc_id") == F.col("_id")).select("band", "doc_id", "rank"))
    hubs = members.groupBy(F.col("band").alias("_band")).agg(F.min(F.struct((-F.col("rank")).alias("r"), F.col("doc_id").alias("d"))).alias("h"))
    met = materialize(members.join(hubs, F.col("band") == F.col("_band")).select("band", "doc_id", F.col("h.d").alias("hub")))
    sets = materialize(docs.select("doc_id", "text").mapInArrow(shingle_sets(weighted, sieve_of(members.select(F.col("doc_id").alias("_w")))), SETS))
    pairs = materialize(met.filter("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct())
    first = materialize(verified(pairs, sets, threshold).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = components(first)
    comp = lambda name: labels.select(F.col("node").alias(f"_{name}"), F.col("label").alias(f"{name}_label"))
    parts = met.join(comp("d"), F.col("doc_id") == F.col("_d"), "left").join(comp("h"), F.col("hub") == F.col("_h"), "left")
    parts = materialize(parts.select("band", "doc_id", F.coalesce("d_label", "doc_id").alias("comp"), (F.coalesce("d_label", "doc_id") != F.coalesce("h_label", "hub")).alias("apart")))
    torn = parts.filter("apart").select(F.col("band").alias("_band")).distinct()
    again = materialize(parts.join(torn, F.col("band") == F.col("_band"), "left_semi").select("doc_id", "comp").distinct())
    some = materialize(sets.join(again.select(F.col("doc_id").alias("_w")), F.col("_id") == F.col("_w"), "left_semi").dropDuplicates(["_id"]))
    second = materialize(verified(materialize(across(again, some, threshold)), some, threshold))
    return first.unionByName(second)


def classes(docs: DataFrame, threshold: float = 0.8, weighted: bool = False) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) and n_links for each document.

    Classes are the connected parts of links of threshold or more in Jaccard similarity of
    five-word shingles: sets, or with weighted bags. Documents of one shingle set are one
    node, so copies cost one comparison; n_links counts the links found for a node, enough to join its class.

    Null and empty texts, and texts without a word, are classes of their own. Rows that
    share a doc_id are one document, which is like what one of them is like. A null doc_id is
    left out. An empty table gives no rows; other columns are ignored.
    """
    keyed = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = materialize(keyed.mapInArrow(sketch(weighted), SIGNED))
    full = sketches.filter("n > 0")
    nodes = full.groupBy("n", "set1", "set2").agg(F.min("doc_id").alias("rep"))
    nodes = materialize(nodes)
    own = materialize(sketches.join(nodes.select(F.col("rep").alias("_rep")).distinct(), F.col("doc_id") == F.col("_rep"), "left_semi").select("doc_id", "bands").filter(F.size("bands") > 0).dropDuplicates(["doc_id"]))
    found = links(own, keyed, threshold, weighted)
    labels = components(found)
    degrees = found.select(F.explode(F.array("a", "b")).alias("_d")).groupBy("_d").agg(F.count("*").alias("n_links"))
    named = nodes.join(labels, F.col("rep") == F.col("node"), "left").join(degrees, F.col("rep") == F.col("_d"), "left")
    named = named.select(F.col("n").alias("_n"), F.col("set1").alias("_s1"), F.col("set2").alias("_s2"), F.coalesce("label", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    ids = sketches.select("doc_id", "n", "set1", "set2")
    placed = ids.filter("n > 0").join(named, (F.col("n") == F.col("_n")) & (F.col("set1") == F.col("_s1")) & (F.col("set2") == F.col("_s2"))).select("doc_id", "class_id", "n_links")
    alone = ids.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return placed.unionByName(alone).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))


def deduplicated(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One document of each class, the least doc_id, with all its columns, whatever their names.

    Rows that share a doc_id are one document, so one of them stays. Rows of a null doc_id
    belong to no class and stay, as do null and empty texts. An empty table stays empty.
    """
    key = fresh(docs, "kept")
    kept = classes(docs, threshold).filter("class_id = doc_id").select(F.col("doc_id").alias(key))
    named = docs.filter(F.col("doc_id").isNotNull()).join(kept, F.col("doc_id") == F.col(key), "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
