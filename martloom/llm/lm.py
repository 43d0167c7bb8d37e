"""LM scoring: a Katz backoff bigram model with Good-Turing discounts.

Counts and lookups move as packed arrays, not as a row for each bigram. A chunk is some
millions of tokens of neighbouring documents, as numbers into the chunk's own vocabulary.
  1. Vocabularies meet by word hash: each part of the hash range adds up its words' counts
     and gives each word an id, frequent words first, so that an id tells its count.
  2. A chunk's different bigrams go, as (history, word) ids with their training counts, to
     the part of their history; a part adds them up, stores its table of counts and answers
     each chunk with the counts of its bigrams and what a history's backoff weight needs.
  3. A chunk adds the documents' log probabilities.
There are as many parts as keep each at PART_TOKENS tokens or so. The bigrams of histories
that would fill a good share of a part are dealt by the pair, and those histories' sums, a
row for each of a few times as many histories as there are parts, are added over all parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martloom.llm.common import SPACED, Words, materialize, mix, slices, table

CHUNK_TOKENS = 2_500_000
END = np.uint64(0xE4D0)
BOS_ID, UNK_ID, FIRST_ID = 0, 1, 2
#: Tokens for each part of the histories, on average, and the share of a part from which a history is dealt by the pair.
PART_TOKENS, HOT_SHARE = 4_000_000, 1 / 16
CUT = 5

CHUNKS = "chunk long, doc_ids array<long>, held binary, counts binary, tokens binary, ranks binary, vocab binary, trained binary"
SPLIT = "part int, chunk long, words binary, trained binary"
VOCAB = "part int, words binary, counts binary, chunks array<long>, places array<binary>"
COUNTED = "part int, c long, n long"
IDS = "chunk long, part int, ids binary"
PAIRS = "part int, chunk long, pairs binary, trained binary"
ANSWERS = "chunk long, part int, found binary, sums array<binary>, pairs binary, counts binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def packed(a: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, as many as the largest needs, compressed."""
    a = np.ascontiguousarray(a, np.uint64)
    k = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = a.view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()
    return bytes([k]) + len(a).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    k, n = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.decompress(raw[9:], n * k, codec="zstd", asbytes=True), np.uint8).reshape(k, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :k] = planes.T
    return out.view(np.uint64).reshape(-1)


def steps(a: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return packed(np.diff(a.astype(np.uint64), prepend=np.uint64(0)))


def unsteps(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


def batch(schema: list[str], rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], schema)


LONG, INT, BIN = pa.int64(), pa.int32(), pa.binary()


def cut(limit: int):
    """Chunks of a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, seq = TaskContext.get().partitionId() << 24, 0
        ids, held, counts, hashes = [], [], [], []

        def flush() -> pa.RecordBatch:
            n, away = np.concatenate(counts), np.concatenate(held)
            vocab, which, seen = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            trained = np.bincount(which[np.repeat(~away, n)], minlength=len(vocab))
            order = np.argsort(-seen, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            row = (first + seq, [i for x in ids for i in x], packed(away), packed(n), packed(rank[which]), packed(order), steps(vocab), packed(trained))
            return batch(["chunk", "doc_ids", "held", "counts", "tokens", "ranks", "vocab", "trained"], [row], [LONG, pa.list_(LONG), *[BIN] * 6])

        for part in slices(batches):
            w = Words(part.column("text"), SPACED, lower=True)
            hashes.append(np.insert(w.hashes(), w.rows[1:], END))
            counts.append(w.counts() + 1)
            held.append(part.column("held").to_numpy(zero_copy_only=False).astype(bool))
            ids.append(part.column("doc_id").to_pylist())
            if sum(map(len, hashes)) >= limit:
                yield flush()
                seq += 1
                ids, held, counts, hashes = [], [], [], []
        if ids:
            yield flush()

    return run


def split(parts: int):
    """A chunk's vocabulary by ranges of the word hash."""
    limits = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, vocab, trained in zip(*[b.column(c).to_pylist() for c in ("chunk", "vocab", "trained")], strict=True):
                words, n = unsteps(vocab), unpacked(trained)
                at = [0, *np.searchsorted(words, limits).tolist(), len(words)]
                rows = [(p, chunk, steps(words[a:z]), packed(n[a:z])) for p, (a, z) in enumerate(zip(at, at[1:], strict=False)) if z > a]
                yield batch(["part", "chunk", "words", "trained"], rows, [INT, LONG, BIN, BIN])

    return run


def vocabulary(t: pa.Table) -> pa.Table:
    """The words of a part of the hash range with their counts, and where each chunk's are among them."""
    words = [unsteps(x) for x in t.column("words").to_pylist()]
    trained = np.concatenate([unpacked(x) for x in t.column("trained").to_pylist()])
    every, which = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.bincount(which, trained.astype(np.float64), len(every))
    ends = np.cumsum([len(w) for w in words]).tolist()
    places = [steps(which[a:z]) for a, z in zip([0, *ends], ends, strict=False)]
    row = (t.column("part")[0].as_py(), steps(every), packed(counts.astype(np.uint64)), t.column("chunk").to_pylist(), places)
    return pa.Table.from_batches([batch(["part", "words", "counts", "chunks", "places"], [row], [INT, BIN, BIN, pa.list_(LONG), pa.list_(BIN)])])


def counts_of_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part, raw in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
            c, n = np.unique(unpacked(raw).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part), INT), pa.array(c), pa.array(n)], ["part", "c", "n"])


def discounts(n: list[float]) -> np.ndarray:
    """Good-Turing factors for counts 0 to CUT (the first unused), from the numbers of kinds seen 1 to CUT + 1 times; (r - 1/2) / r where those don't give a factor between 0 and 1."""
    out = np.array([1.0] + [(r - 0.5) / r for r in range(1, CUT + 1)])
    common = (CUT + 1) * n[CUT] / n[0] if n[0] else 1.0
    for r in range(1, CUT + 1):
        if common < 1 and n[r - 1] and n[r]:
            d = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common)
            out[r] = d if 0 < d < 1 else out[r]
    return out


class Unigrams:
    """Word classes by count: ids, counts and discounted probabilities. classes: (count, words); their number grows as the square root of the tokens at most.

    Ids have no gaps, so two fit in a key of 64 bits up to 4 billion different words, which
    is as far as 64-bit hashes tell words apart.
    """

    def __init__(self, classes: list[tuple[int, int]], parts: int) -> None:
        known = sorted((c for c in classes if c[0] > 0), reverse=True)
        self.counts = np.array([c for c, _ in known], np.int64)
        self.offsets = FIRST_ID + np.concatenate([[0], np.cumsum([w for _, w in known])]).astype(np.int64)
        self.width = max(1, int(self.offsets[-1]).bit_length())
        if 2 * self.width > 64:
            raise ValueError(f"{self.offsets[-1]} different words: 64-bit hashes don't tell them apart")
        kinds = np.array([n for _, n in known], np.float64)
        self.tokens = int((self.counts * kinds).sum())
        self.words = int(kinds.sum())
        # Ids are in order of count, so the frequent histories are those below one id, whatever the number of parts; so are BOS and the unknown word.
        self.hot = int(self.offsets[np.searchsorted(-self.counts, -HOT_SHARE * self.tokens / parts)])
        by = dict(zip(self.counts.tolist(), kinds.tolist(), strict=True))
        d = discounts([by.get(r, 0.0) for r in range(1, CUT + 2)])
        share = np.where(self.counts <= CUT, d[np.minimum(self.counts, CUT)], 1.0) * self.counts / max(self.tokens, 1)
        left = 1 - float((share * kinds).sum())
        if left < 1e-12:
            share, left = share * self.tokens / (self.tokens + 1), 1 / (self.tokens + 1)
        self.share, self.unknown = share, left

    def _class(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, ids.astype(np.int64), "right") - 1

    def count(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        known = ids >= FIRST_ID
        out[known] = self.counts[self._class(ids[known])]
        return out

    def probability(self, ids: np.ndarray) -> np.ndarray:
        out = np.full(len(ids), self.unknown)
        known = ids >= FIRST_ID
        out[known] = self.share[self._class(ids[known])]
        return out

    def ids(self, counts: np.ndarray, starts: dict[int, int]) -> np.ndarray:
        """Ids of a part's words. starts: of each count, how many words of lower parts have it."""
        out = np.full(len(counts), UNK_ID, np.int64)
        at = np.flatnonzero(counts)
        at = at[np.argsort(counts[at], kind="stable")]
        c = counts[at]
        new = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
        nth = np.arange(len(c)) - np.repeat(new, np.diff(np.append(new, len(c))))
        ahead = np.repeat(np.array([starts.get(k, 0) for k in c[new].tolist()], np.int64), np.diff(np.append(new, len(c))))
        out[at] = self.offsets[len(self.counts) - 1 - np.searchsorted(self.counts[::-1], c)] + ahead + nth
        return out


def word_ids(unigrams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, raw, chunks, places, starts in zip(*[b.column(c).to_pylist() for c in ("part", "counts", "chunks", "places", "starts")], strict=True):
                ids = unigrams.value.ids(unpacked(raw).astype(np.int64), {x["c"]: x["start"] for x in starts or ()})
                yield batch(["chunk", "part", "ids"], [(c, part, packed(ids[unsteps(p).astype(np.int64)])) for c, p in zip(chunks, places, strict=True)], [LONG, INT, BIN])

    return run


class Chunk:
    """A chunk with ids, and its different bigrams in the order in which parts get them."""

    def __init__(self, row: dict, ids: dict[int, bytes], u: Unigrams, parts: int) -> None:
        self.n = unpacked(row["counts"]).astype(np.int64)
        self.held = unpacked(row["held"]).astype(bool)
        local = np.concatenate([unpacked(ids[p]) for p in sorted(ids)])
        self.words = local[unpacked(row["ranks"]).astype(np.int64)][unpacked(row["tokens"]).astype(np.int64)]
        before = np.empty_like(self.words)
        before[1:] = self.words[:-1]
        before[np.cumsum(self.n) - self.n] = BOS_ID
        keys, which = np.unique((before << np.uint64(u.width)) | self.words, return_inverse=True)
        history = keys >> np.uint64(u.width)
        part = (np.where(history < u.hot, mix(keys.copy()), mix(history)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.pairs, self.which, self.part = keys[order], place[which], part[order]
        self.history = history[order]

    def trained(self) -> np.ndarray:
        return np.bincount(self.which[np.repeat(~self.held, self.n)], minlength=len(self.pairs))


def pairs_of(unigrams, parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            chunk = Chunk(row, dict(zip(right.column("part").to_pylist(), right.column("ids").to_pylist(), strict=True)), unigrams.value, parts)
            n = chunk.trained()
            at = np.searchsorted(chunk.part, np.arange(parts + 1)).tolist()
            rows += [(p, row["chunk"], steps(chunk.pairs[a:z]), packed(n[a:z])) for p, (a, z) in enumerate(zip(at, at[1:], strict=False)) if z > a]
        return pa.Table.from_batches([batch(["part", "chunk", "pairs", "trained"], rows, [INT, LONG, BIN, BIN])])

    return run


def sums_of(history: np.ndarray, counts: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each history, ascending: how many words follow it 1 to CUT times, and the unigram probability of all that follow it."""
    names, which = np.unique(history, return_inverse=True)
    kinds = [np.bincount(which[counts == r], minlength=len(names)) for r in range(1, CUT + 1)]
    return names, [*kinds, np.bincount(which, share * (counts > 0), len(names))]


def answers(unigrams):
    def run(t: pa.Table) -> pa.Table:
        u, part = unigrams.value, t.column("part")[0].as_py()
        asked = [unsteps(x) for x in t.column("pairs").to_pylist()]
        trained = np.concatenate([unpacked(x) for x in t.column("trained").to_pylist()]).astype(np.float64)
        keys, which = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.bincount(which, trained, len(keys)).astype(np.int64)
        history, word = keys >> np.uint64(u.width), keys & np.uint64((1 << u.width) - 1)
        seen = counts > 0
        names, sums = sums_of(history, counts, u.probability(word))
        ends, rows = np.cumsum([len(a) for a in asked]).tolist(), []
        for chunk, a, z in zip(t.column("chunk").to_pylist(), [0, *ends], ends, strict=False):
            at = np.searchsorted(names, np.unique(history[which[a:z]]))
            at = at[names[at] >= u.hot]
            rows.append((chunk, part, packed(counts[which[a:z]]), [*[packed(s[at]) for s in sums[:-1]], packed(sums[-1][at].view(np.uint64))], None, None))
        hot = names < u.hot
        total = np.bincount(np.searchsorted(names, history), counts.astype(float), len(names))[hot]
        tops = [packed(names[hot]), *[packed(s[hot]) for s in sums[:-1]], packed(sums[-1][hot].view(np.uint64)), packed(total.astype(np.uint64))]
        rows.append((-1, part, packed(np.bincount(counts[(counts > 0) & (counts <= CUT + 1)], minlength=CUT + 2)), tops, steps(keys[seen]), packed(counts[seen])))
        return pa.Table.from_batches([batch(["chunk", "part", "found", "sums", "pairs", "counts"], rows, [LONG, INT, BIN, pa.list_(BIN), BIN, BIN])])

    return run


def hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of frequent histories in a part's table, as rows (history, kinds 1 to CUT, share, total)."""
    for b in batches:
        for sums in b.column("sums").to_pylist():
            a = [unpacked(x) for x in sums]
            columns = [pa.array(a[0].astype(np.int64)), *[pa.array(x.astype(np.float64)) for x in a[1 : CUT + 1]], pa.array(a[CUT + 1].view(np.float64)), pa.array(a[CUT + 2].astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, ["h", *[f"k{r}" for r in range(1, CUT + 1)], "share", "total"])


def kind_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column("found").to_pylist():
            n = unpacked(raw).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["r", "n"])


class Katz:
    """Bigram probabilities from counts. A history whose words all occur over CUT times would leave nothing: there one unseen occurrence is added."""

    def __init__(self, unigrams: Unigrams, kinds: list[float], hot: list[tuple]) -> None:
        self.unigrams, self.d = unigrams, discounts(kinds)
        self.frequent = {int(r[0]): r[1:] for r in hot}

    def weights(self, kinds: list[np.ndarray], share: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backoff weight and denominator of histories."""
        freed = sum(r * k.astype(np.float64) * (1 - self.d[r]) for r, k in enumerate(kinds, 1))
        none = freed <= 0
        below = np.where(none, total + 1, total)
        alpha = np.where(total > 0, np.where(none, 1.0, freed) / np.maximum(below, 1) / np.maximum(1 - share, 1e-300), 1.0)
        return alpha, np.maximum(below, 1)

    def log10(self, found: np.ndarray, words: np.ndarray, alpha: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Of each bigram: discounted if seen, else backed off to the word's own probability."""
        factor = np.where(found <= CUT, self.d[np.minimum(found, CUT)], 1.0)
        return np.log10(np.where(found > 0, factor * found / below, alpha * self.unigrams.probability(words)))


def scores_of(model, parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        katz: Katz = model.value
        u, out = katz.unigrams, []
        for row in left.to_pylist():
            kind = right.to_pylist()
            chunk = Chunk(row, {r["part"]: r["ids"] for r in kind if r["ids"] is not None}, u, parts)
            got = sorted(((r["part"], r["found"], r["sums"]) for r in kind if r["found"] is not None), key=lambda r: r[0])
            found = np.concatenate([unpacked(r[1]) for r in got]).astype(np.int64)
            alpha, below = np.ones(len(found)), np.ones(len(found))
            for p, _, sums in got:
                a, z = np.searchsorted(chunk.part, [p, p + 1])
                history = chunk.history[a:z]
                names = np.unique(history[history >= u.hot])
                a_w, b_w = katz.weights([unpacked(s) for s in sums[:CUT]], unpacked(sums[CUT]).view(np.float64), u.count(names))
                at = np.searchsorted(names, history)
                calm = history >= u.hot
                alpha[a:z][calm], below[a:z][calm] = a_w[at[calm]], b_w[at[calm]]
            hot = np.flatnonzero(chunk.history < u.hot)
            if len(hot):
                names, which = np.unique(chunk.history[hot], return_inverse=True)
                rows = np.array([katz.frequent.get(int(h), (0.0,) * (CUT + 2)) for h in names])
                a_w, b_w = katz.weights(list(rows[:, :CUT].T), rows[:, CUT], rows[:, CUT + 1])
                alpha[hot], below[hot] = a_w[which], b_w[which]
            logs = katz.log10(found, chunk.pairs & np.uint64((1 << u.width) - 1), alpha, below)
            first = np.cumsum(chunk.n) - chunk.n
            c = u.count(chunk.words)
            base = np.add.reduceat(np.log10((c + 0.5) / (u.tokens + 0.5 * (u.words + 1))), first)
            score = np.add.reduceat(logs[chunk.which], first)
            known = np.add.reduceat((c > 0).astype(np.int64), first)
            columns = [pa.array(row["doc_ids"], LONG), pa.array(chunk.held), pa.array(chunk.n), pa.array(known), pa.array(np.full(len(first), u.tokens)), pa.array(base), pa.array(score)]
            out.append(pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.Table.from_batches(out, schema=None if out else pa.schema([("doc_id", LONG), ("held_out", pa.bool_()), ("n_tokens", LONG), ("n_known", LONG), ("train_tokens", LONG), ("base_score", pa.float64()), ("score", pa.float64())]))

    return run


def chunk_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(unpacked(raw).sum()) for raw in b.column("counts").to_pylist()], LONG)], ["n"])


def score(docs: DataFrame, held_out=None, chunk_tokens: int = CHUNK_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Scores of all documents under the model of those that aren't held out (a Column; by default crc32(doc_id) mod 5 is 1).

    Tokens are words, A-Z in lower case, and one end. A word that training hasn't is the one
    unknown word. A null or empty text is its end alone; a null doc_id is for training;
    rows that share a doc_id are documents of their own; an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    if held_out is None:
        held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), "text")
    chunks = materialize(given.mapInArrow(cut(chunk_tokens), CHUNKS))
    tokens = chunks.select("counts").mapInArrow(chunk_sizes, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // part_tokens))
    vocab = materialize(chunks.select("chunk", "vocab", "trained").mapInArrow(split(parts), SPLIT).groupBy("part").applyInArrow(vocabulary, VOCAB))
    counted = materialize(vocab.select("part", "counts").mapInArrow(counts_of_counts, COUNTED).filter("c > 0"))
    classes = counted.groupBy("c").agg(F.sum("n").alias("words")).collect()
    unigrams = Unigrams([(r[0], r[1]) for r in classes], parts)
    sent = spark.sparkContext.broadcast(unigrams)
    lower = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("part", "c", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("start"))
    starts = starts.groupBy("part").agg(F.collect_list(F.struct("c", "start")).alias("starts"))  # a row for each count in the part
    ids = vocab.select("part", "counts", "chunks", "places").join(starts, "part", "left").mapInArrow(word_ids(sent), IDS)
    texts = chunks.select("chunk", "doc_ids", "held", "counts", "tokens", "ranks")
    pairs = texts.drop("doc_ids").groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(pairs_of(sent, parts), PAIRS)
    answered = materialize(pairs.groupBy("part").applyInArrow(answers(sent), ANSWERS))
    tables = answered.filter("chunk = -1")
    kinds = {r[0]: float(r[1]) for r in tables.select("found").mapInArrow(kind_rows, "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).collect()}
    names = [*[f"k{r}" for r in range(1, CUT + 1)], "share", "total"]
    hot = tables.select("sums").mapInArrow(hot_rows, "h long, " + ", ".join(f"{n} double" for n in names)).groupBy("h").agg(*[F.sum(n).alias(n) for n in names]).collect()
    model = spark.sparkContext.broadcast(Katz(unigrams, [kinds.get(r, 0.0) for r in range(1, CUT + 2)], [tuple(r) for r in hot]))
    replies = answered.filter("chunk >= 0").select("chunk", "part", F.lit(None).cast("binary").alias("ids"), "found", "sums")
    both = ids.select("chunk", "part", "ids", F.lit(None).cast("binary").alias("found"), F.lit(None).cast("array<binary>").alias("sums")).unionByName(replies)
    return texts.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(scores_of(model, parts), SCORES)


def query(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
