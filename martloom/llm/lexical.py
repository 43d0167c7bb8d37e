"""Ranked lexical search: term owners in a pipeline add to item bundles that carry sparse document accumulators.

Documents are cut into blocks as they are read, and a block's postings, one row for each
term that items ask for, are written once. Terms are dealt to owners by their weight, so
that owners hold about as many postings each, the rarest terms first. A bundle is a group of
items before a block; it visits the owners one after the other. A visit is a cogroup of the
bundles with the owner's postings: integer contributions are added to the accumulators,
which go on to the next owner. After each visit an accumulator goes that can't reach the
k-th best of its item and block any more, even with the most that later terms can add: that
is exact, since a document among the k best of all is among the k best of its block. The
last owner leaves each block's k best, of which a window takes the k best of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martloom.llm.common import ALNUM, Words, materialize, signed, slices, table
from martloom.llm.decontam import Sieve, sieve_of

BEST = 20
#: Term owners, and items of a bundle.
OWNERS, GROUP = 4, 256
#: A block ends with so many documents or postings.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 14, 1 << 21
#: No occurrence of a term adds more than this times the term's weight.
MOST = 1_000_000

ASKED = "item_id long, term long, n long"
POSTINGS = "block long, term long, n long, words long, docs binary, tfs binary, ids array<long>"
BUNDLES = "block long, bundle int, ids array<long>, ms binary, items array<long>, later array<array<long>>, docs array<binary>, scores array<binary>"
FOUND = "item_id long, doc_id long, score long"
LONG = pa.int64()


def small(a: np.ndarray) -> bytes:
    """Unsigned numbers in as many bytes each as the largest needs."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)).tobytes()


def wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // n}" if n else "u1").astype(np.int64)


def counted(terms: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (term, row) with the number of times they occur, by term."""
    every, which = np.unique(terms, return_inverse=True)
    pairs, n = np.unique(which * n_rows + rows, return_counts=True)
    return every[pairs // n_rows], pairs % n_rows, n


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        w = Words(part.column("text"), ALNUM, lower=True)
        term, row, n = counted(signed(w.hashes()), np.repeat(np.arange(part.num_rows), w.counts()), max(part.num_rows, 1))
        yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(row)), pa.array(term), pa.array(n)], ["item_id", "term", "n"])


def postings(sent):
    """Of each block of documents: a row with the ids and lengths, and a row for each term that passes the sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, block = Sieve(sent.value), TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        ids: list[int | None] = []
        lengths: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            n = np.concatenate(lengths)
            rows = [(block, None, int((n > 0).sum()), int(n.sum()), small(n), None, ids)]
            term, doc, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(term, kind="stable")
            term, doc, tf = term[order], doc[order], tf[order]
            new = [0, *(np.flatnonzero(np.diff(term)) + 1).tolist()] if len(term) else []
            ends = [*new[1:], len(term)][: len(new)]
            rows += [(block, int(term[a]), z - a, None, small(doc[a:z]), small(tf[a:z]), None) for a, z in zip(new, ends, strict=True)]
            types = [LONG, LONG, LONG, LONG, pa.binary(), pa.binary(), pa.list_(LONG)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["block", "term", "n", "words", "docs", "tfs", "ids"])

        for part in slices(batches):
            w = Words(part.column("text"), ALNUM, lower=True)
            h = signed(w.hashes())
            at = known.places(h)
            row = np.searchsorted(w.rows, at, "right") - 1
            term, doc, tf = counted(h[at], row, part.num_rows)
            held.append((term, doc + len(ids), tf))
            lengths.append(w.counts())
            ids += part.column("doc_id").to_pylist()
            size += len(term)
            if len(ids) >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                yield flush()
                block, held, ids, lengths, size = block + 1, [], [], [], 0
        if ids:
            yield flush()

    return run


def visit(k: int, owner: int, owners: int):
    """A bundle at a term owner: contributions are added, accumulators that can't win go; the last owner gives the k best."""
    last = owner == owners - 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        terms = right.select(["n", "docs", "tfs", "uses"]).to_pylist()
        for b in left.to_pylist():
            m = np.frombuffer(b["ms"], np.int64)
            place = {item: i for i, item in enumerate(b["items"])}
            total = np.zeros((len(place), len(m)), np.int64)
            for i, (docs, scores) in enumerate(zip(b["docs"] or [], b["scores"] or [], strict=True)):
                total[i, np.frombuffer(docs, np.uint32)] = np.frombuffer(scores, np.int64)
            for t in terms:
                docs, tf = wide(t["docs"], t["n"]), wide(t["tfs"], t["n"])
                share = (1_000_000_000 * tf) // (1000 * tf + 12 * m[docs])
                for use in t["uses"]:
                    total[place[use["item_id"]], docs] += use["weight"] * share
            kept = []
            for i, item in enumerate(b["items"]):
                docs = np.flatnonzero(total[i])
                scores = total[i, docs]
                if len(docs) > k:
                    least = np.partition(scores, len(docs) - k)[len(docs) - k]
                    good = scores >= least - (0 if last else MOST * b["later"][i][owner])
                    docs, scores = docs[good], scores[good]
                if last:
                    named = sorted(((-s, b["ids"][d] is None, b["ids"][d] or 0) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)))[:k]
                    out += [(item, None if none else d, -s) for s, none, d in named]
                else:
                    kept.append((docs.astype(np.uint32).tobytes(), scores.tobytes()))
            if not last:
                out.append((b["block"], b["bundle"], b["ids"], b["ms"], b["items"], b["later"], [d for d, _ in kept], [s for _, s in kept]))
        if last:
            names, types = ["item_id", "doc_id", "score"], [LONG] * 3
        else:
            names = ["block", "bundle", "ids", "ms", "items", "later", "docs", "scores"]
            types = [LONG, pa.int32(), pa.list_(LONG), pa.binary(), pa.list_(LONG), pa.list_(pa.list_(LONG)), pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return run


def bounded_lengths(n_docs: int, n_words: int):
    """Of each document of a block, what its length puts below the division."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ms = [(75 + 25 * wide(raw, len(ids)) * n_docs // max(n_words, 1)).tobytes() for raw, ids in zip(b.column("docs").to_pylist(), b.column("ids").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("ids"), pa.array(ms, pa.binary())], ["block", "ids", "ms"])

    return run


def limits(by_weight: list[tuple[int, int]], owners: int) -> list[int]:
    """Weights down to which the owners but the last go, so that all have about as many postings. by_weight: (weight, postings)."""
    out, seen, total = [], 0, sum(n for _, n in by_weight)
    for weight, n in sorted(by_weight, reverse=True):
        seen += n
        while len(out) < owners - 1 and seen * owners >= total * (len(out) + 1):
            out.append(weight)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = BEST, owners: int = OWNERS, group: int = GROUP) -> DataFrame:
    """The k documents that score highest for each item: item_id, rank, doc_id, score. Scores are above 0; equal ones go by ascending doc_id, null last.

    Terms are runs of letters, digits and characters above 127, A-Z in lower case. A null or
    empty text has none: such a document counts in nothing and is never found, such an item
    finds nothing. Rows that share an item_id are one item with the terms of all; a row
    without item_id asks for nothing. Rows that share a doc_id are documents of their own,
    null included. Empty tables give no rows. Other columns are ignored. Terms are compared
    by 64-bit hash.
    """
    spark = docs.sparkSession
    asked = items.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(item_terms, ASKED)
    asked = materialize(asked.groupBy("item_id", "term").agg(F.sum("n").alias("n")))
    sent = sieve_of(asked.select(F.col("term").alias("key")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stored = materialize(texts.mapInArrow(postings(sent), POSTINGS))
    heads, lists = stored.filter("term is null"), stored.filter("term is not null").select("block", "term", "n", "docs", "tfs")
    n_docs, n_words = heads.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    held = lists.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = materialize(asked.join(held, "term").withColumn("w", weight).filter("w > 0"))
    # One row a weight: 1000 ln(2 n_docs + 2) of them at most, 50,000 for 1e21 documents.
    cuts = limits([tuple(r) for r in weighed.dropDuplicates(["term"]).groupBy("w").agg(F.sum("df")).collect()], owners)
    owner = sum(((F.col("w") < c).cast("int") for c in cuts), F.lit(0))
    bundles = max(1, -(-weighed.select("item_id").distinct().count() // group))
    bundle = F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("int")
    used = weighed.select(bundle.alias("bundle"), "item_id", "term", owner.alias("owner"), (F.col("w") * F.col("n")).alias("weight"))
    later = F.array(*[F.sum(F.when(F.col("owner") > o, F.col("weight")).otherwise(0)) for o in range(owners)])
    each = used.groupBy("bundle", "item_id").agg(later.alias("later"))
    each = each.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("item_id", "later"))).alias("x")).select("bundle", F.col("x.item_id").alias("items"), F.col("x.later").alias("later"))
    uses = used.groupBy("bundle", "term", "owner").agg(F.collect_list(F.struct("item_id", "weight")).alias("uses"))
    lent = lists.join(uses, "term").select("block", "bundle", "owner", "n", "docs", "tfs", "uses")
    blocks = heads.select("block", "docs", "ids").mapInArrow(bounded_lengths(n_docs, n_words), "block long, ids array<long>, ms binary")
    none = F.lit(None).cast("array<binary>")
    state = blocks.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1)))).join(each, "bundle").select("block", "bundle", "ids", "ms", "items", "later", none.alias("docs"), none.alias("scores"))
    for o in range(owners):
        owned = lent.filter(F.col("owner") == o).drop("owner")
        state = state.groupBy("block", "bundle").cogroup(owned.groupBy("block", "bundle")).applyInArrow(visit(k, o, owners), FOUND if o == owners - 1 else BUNDLES)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return state.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH dt AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
bt AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS qn FROM bt GROUP BY item_id, term),
len AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM len),
m AS (SELECT doc_id, 75 + (25 * n * nn) // ll AS m FROM len, s),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
sc AS (SELECT item_id, doc_id, CAST(sum(qn * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
