"""Substring dedup by relative Lempel-Ziv parsing: greedy factors of documents in blocks of all earlier ones.

The reference is the corpus itself, cut into blocks where its words say so: of each window
of 50 words the least 8-word hash is the anchor, and windows in a row with one anchor make
a block. Equal windows have equal anchors, so a window need only be looked up in the blocks
that its anchor indexes, and every window lies in exactly one block: nothing is lost at a
block's limit. Equal blocks are indexed and parsed once, under the least doc_id that holds
them; in the others the whole block is one factor.

A block is parsed greedily from its first window: of all blocks of earlier documents with
its anchor, the one that agrees longest from there gives the factor, and parsing goes on at
the first window that the factor doesn't hold, that is 49 words before the factor's end, so
that windows across the limits of factors are looked up too. A factor of n windows has
n + 49 words, 50 at least. Longest agreements are read off the sorted order of all the
places' window runs: the next places before and after it that belong to a lesser document.
Windows agree by 64-bit hash, equal blocks by 128 bits. An anchor with many blocks is dealt
into shares by the distance from a window to the anchor, in which windows of a run are
neighbours, and beyond 43 shares by hash; the union of the factors is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import SPACED, Words, grams, materialize, prefix, signed, slices, stretch, table

WINDOW = 50
ANCHOR = 8
BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
#: Blocks of one anchor for each share into which the anchor's windows are dealt.
SHARE = 20_000

BLOCKS = "doc_id long, start int, n int, away int, anchor long, b1 long, b2 long"
HASHED = "b1 long, b2 long, n int, anchor long, share int, d0 long, start int, place int, hashes binary"
#: A factor: windows from to to of a block, which are those of document doc from window at on.
FACTORS = "array<struct<from:int,to:int,doc:long,at:int>>"
FOUND = f"b1 long, b2 long, n int, runs {FACTORS}"


def cut(window: int):
    """Blocks of each document: their first window, number of windows, words from the first to the anchor, anchor and two hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w = Words(part.column("text"), SPACED)
            h = w.hashes()
            if len(h) < window:
                continue
            row_ends, k = w.row_ends(), window - ANCHOR + 1
            keys = grams(h, ANCHOR)
            at = np.arange(len(h) - window + 1)
            anchor = at + np.lib.stride_tricks.sliding_window_view(keys, k).argmin(1)
            good = at + window <= row_ends[: len(at)]
            new = good.copy()
            new[1:] &= ~good[:-1] | (anchor[1:] != anchor[:-1])
            last = good.copy()
            last[:-1] &= ~good[1:] | (anchor[1:] != anchor[:-1])
            starts, ends = np.flatnonzero(new), np.flatnonzero(last) + 1
            rows = np.searchsorted(w.rows, starts, "right") - 1
            hashes = [signed(stretch(prefix(h, b), b, starts, ends + window - 1)) for b in BASES]
            ids = part.column("doc_id").cast(pa.int64()).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([ids, pa.array(starts - w.rows[rows], pa.int32()), pa.array(ends - starts, pa.int32()), pa.array(anchor[starts] - starts, pa.int32()), pa.array(signed(keys[anchor[starts]])), *map(pa.array, hashes)], ["doc_id", "start", "n", "away", "anchor", "b1", "b2"])

    return run


def share_of(hashes: np.ndarray, away: int, shares: int, window: int) -> np.ndarray:
    """The share of each window of a block whose first window is away words before the anchor."""
    most = window - ANCHOR + 1
    wide, deep = max(1, most // shares), -(-shares // most)
    distance = away - np.arange(len(hashes))
    return distance // wide * deep + (hashes % np.uint64(deep)).astype(np.int64)


def window_hashes(window: int):
    """Hashes of all windows of the blocks that a document stands for: a row for each share of the block's anchor, with the place of its first window in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            w = Words(part.column("text"), SPACED)
            g = grams(w.hashes(), window)
            ids, out = part.column("doc_id").to_pylist(), []
            for row, blocks in enumerate(part.column("blocks").to_pylist()):
                first = int(w.rows[row])
                for b in blocks:
                    h = g[first + b["start"] : first + b["start"] + b["n"]]
                    which = share_of(h, b["away"], b["shares"], window)
                    new = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(h)]
                    out += [(b["b1"], b["b2"], b["n"], b["anchor"], int(which[a]), ids[row], b["start"], a, h[a:z].tobytes()) for a, z in zip(new, new[1:], strict=False)]
            columns = list(zip(*out, strict=True)) or [[]] * 9
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["b1", "b2", "n", "anchor", "share", "d0", "start", "place", "hashes"])

    return run


def agreement(ranks: list[np.ndarray], room: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many windows agree from places a and b on; ranks[j] orders the runs of 2**j windows, or fewer where a stretch ends."""
    same = np.zeros(len(a), np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        on = np.flatnonzero((same < room[a]) & (same < room[b]))
        on = on[ranks[j][a[on] + same[on]] == ranks[j][b[on] + same[on]]]
        same[on] += np.minimum(1 << j, room[a[on]] - same[on])
    return same


def nearest_lesser(doc: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the last one before it with a lesser document (-1: none), and the least of common on the way; common[i] is what places i - 1 and i share, and a 0 ends the way."""
    n, longest = len(doc), int(np.diff(np.flatnonzero(np.append(common == 0, True))).max())
    least_doc, least_common = [doc], [common]
    for j in range((longest - 1).bit_length()):
        d, c = least_doc[-1].copy(), least_common[-1].copy()
        np.minimum(d[1 << j :], least_doc[-1][: -(1 << j)], out=d[1 << j :])
        np.minimum(c[1 << j :], least_common[-1][: -(1 << j)], out=c[1 << j :])
        least_doc.append(d)
        least_common.append(c)
    at, way = np.arange(n) - 1, common.copy()
    for j in range(len(least_doc) - 1, -1, -1):
        on = np.flatnonzero((way > 0) & (at - (1 << j) >= -1))
        on = on[least_doc[j][at[on]] >= doc[on]]
        way[on] = np.minimum(way[on], least_common[j][at[on]])
        at[on] -= 1 << j
    way[at < 0] = 0
    return np.where(way > 0, at, -1), way


def longest_earlier(h: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of stretches that end at ends, with one document each: how many from there on a lesser document's stretch holds, at most, and from which of its places."""
    n = len(h)
    sizes = np.diff(ends, prepend=0)
    at, room = np.arange(n), np.repeat(ends, sizes) - np.arange(n)
    of = np.repeat(np.unique(doc, return_inverse=True)[1].astype(np.int32), sizes)
    ranks = [np.unique(h, return_inverse=True)[1].astype(np.int64) + 1]
    while 1 << (len(ranks) - 1) < int(sizes.max()):
        step, r = 1 << (len(ranks) - 1), ranks[-1]
        then = np.zeros(n, np.int64)
        more = at[room > step]
        then[more] = r[more + step]
        ranks.append(np.unique(r * (n + 1) + then, return_inverse=True)[1].astype(np.int64) + 1)
    order = np.lexsort((of, ranks[-1]))
    common = np.zeros(n, np.int64)
    common[1:] = agreement(ranks, room, order[:-1], order[1:])
    before, left = nearest_lesser(of[order], common)
    after, right = nearest_lesser(of[order][::-1], np.append(0, common[:0:-1]))
    after, right = n - 1 - after[::-1], right[::-1]
    length, source = np.empty(n, np.int64), np.empty(n, np.int64)
    length[order] = np.maximum(left, right)
    source[order] = order[np.where(left >= right, before, np.minimum(after, n - 1))]
    return length, source


def greedy(length: np.ndarray) -> list[int]:
    """Places at which factors start: the first that has a match, then the first from the end of the factor on."""
    n, out = len(length), []
    next_match = np.minimum.accumulate(np.where(length > 0, np.arange(n), n)[::-1])[::-1].tolist()
    i = 0
    while i < n and (i := next_match[i]) < n:
        out.append(i)
        i += int(length[i])
    return out


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors of each block in blocks of lesser documents. Blocks come by anchor and share; those of one are looked at together."""
    kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("doc", pa.int64()), ("at", pa.int32())]))

    def judged(t: pa.Table) -> pa.RecordBatch:
        doc, start, place = (t.column(c).to_numpy() for c in ("d0", "start", "place"))
        h = np.frombuffer(b"".join(t.column("hashes").to_pylist()), np.uint64)
        sizes = pc.binary_length(t.column("hashes")).to_numpy().astype(np.int64) // 8
        ends = np.cumsum(sizes)
        length, source = longest_earlier(h, ends, doc)
        begins = np.array(greedy(length), np.int64)
        block, held_by = (np.searchsorted(ends, x, "right") for x in (begins, source[begins]))
        first = ends - sizes
        frm = begins - first[block] + place[block]
        at = source[begins] - first[held_by] + place[held_by] + start[held_by]
        rows, new = np.unique(block, return_index=True)
        columns = [frm.astype(np.int32), (frm + length[begins]).astype(np.int32), doc[held_by], at.astype(np.int32)]
        every = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(kind.value_type))
        t = t.take(pa.array(rows))
        runs = pa.ListArray.from_arrays(pa.array(np.append(new, len(begins)), pa.int32()), every)
        return pa.RecordBatch.from_arrays([t.column(c).combine_chunks() for c in ("b1", "b2", "n")] + [runs.cast(kind)], ["b1", "b2", "n", "runs"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < SHARE:
            continue
        t = pa.Table.from_batches(held)
        anchors, shares = t.column("anchor").to_numpy(), t.column("share").to_numpy()
        change = np.flatnonzero((anchors != anchors[-1]) | (shares != shares[-1]))
        if len(change):  # all but the last anchor and share are complete
            to = int(change[-1]) + 1
            yield judged(t.slice(0, to))
            held = t.slice(to).to_batches()
    if held:
        yield judged(pa.Table.from_batches(held))


def factors(docs: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """doc_id and factors: runs of first words (from, to) of windows that document doc, of a lesser doc_id, holds from word at on."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = materialize(docs.select("doc_id", "text").mapInArrow(cut(window), BLOCKS))
    index = blocks.groupBy("anchor", "b1", "b2", "n").agg(F.min(F.struct("doc_id", "start", "away")).alias("first"), F.max("doc_id").alias("last"))
    index = materialize(index.select("anchor", "b1", "b2", "n", F.col("first.doc_id").alias("d0"), F.col("first.start").alias("start"), F.col("first.away").alias("away"), (F.col("last") > F.col("first.doc_id")).alias("again")))
    sharing = index.groupBy(F.col("anchor").alias("_anchor")).agg(F.count("*").alias("_blocks")).filter("_blocks > 1")
    looked = index.join(sharing, F.col("anchor") == F.col("_anchor")).withColumn("shares", F.ceil(F.col("_blocks") / share))
    wanted = looked.groupBy(F.col("d0").alias("_d")).agg(F.collect_list(F.struct("b1", "b2", "n", "away", "anchor", "start", "shares")).alias("blocks"))
    hashed = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("_d")).select("doc_id", "text", "blocks").mapInArrow(window_hashes(window), HASHED)
    hashed = materialize(hashed)
    found = hashed.repartition(n, "anchor", "share").sortWithinPartitions("anchor", "share").mapInArrow(parsed, FOUND)
    found = found.groupBy("b1", "b2", "n").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    found = found.select(F.col("b1").alias("_f1"), F.col("b2").alias("_f2"), F.col("n").alias("_fn"), "runs")
    used = index.join(found, (F.col("b1") == F.col("_f1")) & (F.col("b2") == F.col("_f2")) & (F.col("n") == F.col("_fn")), "left").filter("again or runs is not null")
    used = used.select(F.col("b1").alias("_b1"), F.col("b2").alias("_b2"), F.col("n").alias("_n"), "d0", F.col("start").alias("_start"), "runs")
    met = blocks.join(used, (F.col("b1") == F.col("_b1")) & (F.col("b2") == F.col("_b2")) & (F.col("n") == F.col("_n")))
    whole = F.array(F.struct(F.lit(0).alias("from"), F.col("n").alias("to"), F.col("d0").alias("doc"), F.col("_start").alias("at")))
    runs = F.when(F.col("doc_id") > F.col("d0"), whole).otherwise(F.col("runs"))
    moved = F.transform(runs, lambda r: F.struct((F.col("start") + r["from"]).alias("from"), (F.col("start") + r["to"]).alias("to"), r["doc"].alias("doc"), r["at"].alias("at")))
    placed = met.select("doc_id", moved.alias("runs")).filter("size(runs) > 0")
    return placed.groupBy("doc_id").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for part in slices(batches):
            out = []
            for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist(), strict=True):
                words = (text or "").encode().split()  # of bytes: at the six white-space characters
                n, spans = len(words), []
                for a, b in sorted((r["from"], r["to"] + window - 1) for r in runs or ()):
                    if spans and a <= spans[-1]["end"]:
                        spans[-1]["end"] = max(b, spans[-1]["end"])
                    else:
                        spans.append({"start": a, "end": b})
                for s in reversed(spans):
                    del words[s["start"] : s["end"]]
                out.append((n, n - len(words), b" ".join(words), spans))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([hashlib.sha256(x[2]).hexdigest() for x in out], pa.string()), pa.array([x[3] for x in out], kind)], ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (start, end in words) of what was removed.

    A null or empty text has no words; one of fewer than window words loses none. Rows that
    share a doc_id are one document to each other, so they don't remove each other's words,
    and each loses the spans found in any of them. A null doc_id loses nothing and removes
    nothing. An empty table gives no rows; other columns are ignored.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = factors(keyed.filter("doc_id is not null"), window, share).select(F.col("doc_id").alias("_id"), "runs")
    joined = keyed.join(found, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(removed(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>")


def query(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM g) WHERE least < doc_id),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM f),
k AS (SELECT doc_id, list_sort(list(p)) AS ps FROM p GROUP BY doc_id),
t AS (SELECT doc_id, w, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT t.doc_id, string_agg(x, ' ' ORDER BY t.p) AS s FROM t LEFT JOIN p ON t.doc_id = p.doc_id AND t.p = p.p WHERE p.p IS NULL GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
