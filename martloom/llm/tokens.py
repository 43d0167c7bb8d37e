"""Token ids in binary blocks: canonical length-limited Huffman codes from global counts.

A block holds some documents' ids as one bit string, with the bit offset of every 256th
id, so that a block, and each stretch of it, can be decoded alone. The code is given by
one length for each id; lengths are at most 16, so one table of 65,536 places decodes.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martloom.llm.common import batches_of, materialize, mix, slices, table, text_bytes

LIMIT = 16
STEP = 256
END_ID = 2
#: Pieces that a worker keeps with their ids (about 120 MB), and bytes of text whose pieces are found at once.
CACHE = 600_000
SLICE = 1 << 21
#: Bytes of rows that a task hands to its worker at once. Both hold a batch or two beside the pieces; Spark's default is 64 MB.
BATCH = 1 << 23
# Where the byte-level splitter surely cuts, told by bytes of UTF-8. White space
# is Unicode's; BLANK holds its ASCII bytes, and a byte that isn't SOLID may begin a longer one.
# A run of letters, digits or signs ends where another of them begins, or a blank. Signs are
# without the apostrophe, which may begin a contraction, and control characters; at other
# letters nothing is sure.
BLANK, KIND = np.zeros(256, bool), np.zeros(256, np.uint8)
BLANK[[9, 10, 11, 12, 13, 32]] = True
SOLID = ~BLANK
SOLID[[0xC2, 0xE1, 0xE2, 0xE3]] = False
KIND[33:127] = 3
KIND[48:58] = 2
KIND[65:91] = KIND[97:123] = 1
KIND[39] = 0
LETTER, SIGN = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-&(-/:-@\[-`{-~"
ONE = rf" ?[{LETTER}]+| ?[{SIGN}]+| ?[0-9]+"
#: Bytes of a piece that are compared as three numbers; longer pieces are compared one by one.
SHORT = 24

#: A task's rows, and last one of file -1 with how often it has given each id.
IDS = "doc_id long, file int, nth long, n_tokens int, ids binary"
BLOCK = "file int, block long, doc_ids array<long>, lengths array<int>, points array<long>, bits binary"
READ = "doc_id long, file int, block long, nth int, before long, n_tokens long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it shows, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


def cuts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces start in texts that start and end at at: at each text, and where the splitter surely cuts.

    It cuts before the last blank of white space that something follows, behind it too if it
    isn't a space (a space goes with what follows), and where one kind of characters ends.
    """
    new = np.zeros(len(raw) + 1, bool)
    new[at] = True
    if len(raw) > 1:
        blank, solid, kind = BLANK[raw], SOLID[raw], KIND[raw]
        last = blank[:-1] & solid[1:]
        limits = at[(at > 0) & (at < len(raw))]
        last[limits - 1] = False  # at the end of a text nothing follows
        new[:-2] |= last
        new[1:-1] |= last & (raw[:-1] != 32)
        new[1:-1] |= (kind[:-1] > 0) & (kind[1:] != kind[:-1]) & ((kind[1:] > 0) | blank[1:])
    return np.flatnonzero(new[:-1])


def alike(raw: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces: one of each different string, and for each piece which of those it is. Strings are found by hash and compared by their bytes."""
    size = ends - starts
    padded = np.zeros(len(raw) + SHORT, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + SHORT - 7,), "<u8", padded, strides=(1,))
    words = []
    for j in range(0, SHORT, 8):
        held = np.clip(size - j, 0, 8)
        mask = np.where(held == 8, np.uint64(2**64 - 1), (np.uint64(1) << (8 * held % 64).astype(np.uint64)) - np.uint64(1))
        words.append(eight[np.minimum(starts + j, len(raw))] & mask)
    names: dict[bytes, int] = {}
    for i in np.flatnonzero(size > SHORT).tolist():
        words[0][i] = names.setdefault(data[starts[i] : ends[i]], len(names))
    key = size.astype(np.uint64)
    for w in words:
        key = mix(key ^ w)
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    same = one[which]
    if not ((size == size[same]).all() and all((w == w[same]).all() for w in words)):
        return np.arange(len(starts)), np.arange(len(starts))
    return one, which


class Encoder:
    """Ids of texts, each as the bytes of its ids. The library encodes a piece once while it is kept; a text's ids are those of its pieces, one after the other.

    Pieces are found and told apart for all texts of a slice at once, by their bytes.

    A text that holds an added token's string goes to the library as a whole, and so does
    every text if the tokenizer isn't a byte-level one whose cuts are known.
    """

    def __init__(self, path: str, cache: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        t = self.tokenizer = Tokenizer.from_file(path)
        splits = str(t.pre_tokenizer)
        self.known = t.normalizer is None and splits.startswith("ByteLevel") and "add_prefix_space=False" in splits and "use_regex=True" in splits
        self.added = [a.content.encode() for a in t.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2" if t.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.cache, self.kept, self.older = cache, {}, {}
        line = t.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        # For pieces that the library wouldn't cut further: its model without its splitter. Lengths of tokens tell where a piece ends.
        self.model = Tokenizer(t.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters, self.one, self.inside = byte_letters(), re.compile(ONE).fullmatch, re.compile(r"\s").search
        self.size = np.zeros(t.get_vocab_size(with_added_tokens=True) + 1, np.int64)
        for token, i in t.get_vocab(with_added_tokens=False).items():
            self.size[i] = len(token)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def keep(self, pieces: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw, k = ids.tobytes(), self.type.itemsize
        self.kept.update(zip(map(str.encode, pieces), [raw[a:z] for a, z in zip((k * starts).tolist(), (k * ends).tolist(), strict=True)], strict=True))

    def learn(self, new: list[str]) -> None:
        """Encodes pieces: runs of one kind of characters by the model alone, others as lines of one text, and those with white space inside for themselves."""
        single, lines, apart = [], [], []
        for p in new:
            (single if self.one(p) else apart if self.line is None or self.inside(p, p[0] == " ") or p == " " else lines).append(p)
        if apart:
            self.kept.update(zip(map(str.encode, apart), self.whole(apart), strict=True))
        if single:
            text = "\n".join(single).encode().decode("latin-1").translate(self.letters).replace(self.letters[10], "\n")
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
            ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(p.encode()) for p in single])) + 1
            self.keep(single, ids, np.append(0, ends[:-1]), ends)
        if lines:
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(lines)], add_special_tokens=False)[0].ids, self.type)
            ends = np.append(np.flatnonzero(ids == self.line), len(ids))
            self.keep(lines, ids, np.append(0, ends[:-1] + 1), ends)

    def known_ids(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.kept) > self.cache // 2:  # what isn't used before the next time is forgotten
            self.kept, self.older = {}, self.kept
        found = list(map(self.kept.get, pieces))
        new = [p for p, ids in zip(pieces, found, strict=True) if ids is None]
        if new:
            self.kept.update([(p, self.older[p]) for p in new if p in self.older])
            self.learn([p.decode() for p in new if p not in self.older])
            found = list(map(self.kept.__getitem__, pieces))
        return found

    def by_pieces(self, raw: np.ndarray, data: bytes, at: np.ndarray) -> list[bytes]:
        if not data:
            return [b""] * (len(at) - 1)
        starts = cuts(raw, at)
        ends = np.append(starts[1:], len(raw))
        one, which = alike(raw, data, starts, ends)
        found = self.known_ids([data[a:z] for a, z in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
        ids = np.frombuffer(b"".join(found), self.type)
        n = np.array([len(x) for x in found]) // self.type.itemsize
        count = n[which]
        to = np.cumsum(count)
        flat = ids[np.repeat((np.cumsum(n) - n)[which] - (to - count), count) + np.arange(to[-1])].tobytes()
        limits = (self.type.itemsize * np.append(0, to)[np.searchsorted(starts, at)]).tolist()
        return [flat[a:z] for a, z in zip(limits, limits[1:], strict=False)]

    def encode(self, column: pa.Array) -> list[bytes]:
        raw, at = text_bytes(column)
        data, limits = raw.tobytes(), at.tolist()
        if not self.known:
            return self.whole([data[a:z].decode() for a, z in zip(limits, limits[1:], strict=False)])
        out = self.by_pieces(raw, data, at)
        if any(a in data for a in self.added):
            for i, (a, z) in enumerate(zip(limits, limits[1:], strict=False)):
                if any(x in data[a:z] for x in self.added):
                    out[i] = self.whole([data[a:z].decode()])[0]
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """This worker's encoder, kept from task to task with the pieces it knows."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def to_ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, file, nth = encoder_of(path), TaskContext.get().partitionId(), 0
        total = np.zeros(len(encoder.size), np.int64)
        for part in slices(batches, limit=SLICE):
            end = np.array([END_ID], encoder.type).tobytes()
            raw = [x + end for x in encoder.encode(part.column("text"))]
            n, k = [len(x) // encoder.type.itemsize for x in raw], len(raw)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([file] * k, pa.int32()), pa.array(np.arange(nth, nth + k)), pa.array(n, pa.int32()), pa.array(raw, pa.binary())], ["doc_id", "file", "nth", "n_tokens", "ids"])
            nth += k
            total += np.bincount(np.frombuffer(b"".join(raw), encoder.type), minlength=len(total))
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int32()), pa.array([0]), pa.array([len(used)], pa.int32()), pa.array([np.stack([used, total[used]]).tobytes()], pa.binary())], ["doc_id", "file", "nth", "n_tokens", "ids"])

    return run


def ids_of(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def id_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each id occurs, from a task's last row."""
    for batch in batches:
        for raw in batch.column("ids").to_pylist():
            used, n = np.frombuffer(raw, np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n)], ["id", "n"])


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Best code lengths of at most limit bits for ids of these counts (0: no code), by package-merge.

    In each of limit rounds the items are the symbols and pairs of the last round's items,
    by weight; of the last round the first 2 n - 2 items are taken. Taking an item takes
    the pairs' parts of the round before; a symbol's length is how often it is taken. The
    first k symbols by weight are taken in a round, so only k is kept for each.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    rounds, pairs = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        rounds.append(np.cumsum(by < len(weights)))
        both = both[by]
        pairs = both[: len(both) // 2 * 2].reshape(-1, 2).sum(1)
    take, out = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for symbols in reversed(rounds):
        if take <= 0:
            break
        k = int(symbols[take - 1])
        out[:k] += 1
        take = 2 * (take - k)
    lengths[order] = out
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code, last = 0, 0
    sizes = lengths[order].tolist()
    out = []
    for size in sizes:
        code <<= size - last
        last = size
        out.append(code)
        code += 1
    codes[order] = out
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of all codes, most significant first, and the bit offset of every STEP-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    word, room = at >> 5, 64 - (at & 31) - size
    wide = codes[ids].astype(np.uint64) << room.astype(np.uint64)
    n = int(ends[-1] >> 5) + 2 if len(ends) else 0
    high = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n)
    low = np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return (high + low).astype(np.uint64).astype(">u4").tobytes(), at[::STEP]


class Decoder:
    """Table-driven: the next 16 bits give an id and its length. All stretches of a block go on together."""

    def __init__(self, lengths: np.ndarray) -> None:
        codes, used = canonical(lengths), np.flatnonzero(lengths)
        self.bits = max(LIMIT, int(lengths.max()) if len(lengths) else LIMIT)
        self.id = np.zeros(1 << self.bits, np.uint32)
        self.length = np.ones(1 << self.bits, np.int64)
        order = used[np.lexsort((used, lengths[used]))]
        repeat = np.left_shift(1, self.bits - lengths[order].astype(np.int64))
        start = int(codes[order[0]]) << (self.bits - int(lengths[order[0]])) if len(order) else 0
        n = int(repeat.sum())
        self.id[start : start + n] = np.repeat(order, repeat)
        self.length[start : start + n] = np.repeat(lengths[order].astype(np.int64), repeat)

    def unpack(self, bits: bytes, points: np.ndarray, n: int) -> np.ndarray:
        words = np.frombuffer(bits, ">u4").astype(np.uint64)
        words = np.concatenate([words, np.zeros(2, np.uint64)])
        at = points.astype(np.int64).copy()
        out = np.zeros((STEP, len(at)), np.uint32)
        mask, shift = np.uint64((1 << self.bits) - 1), 64 - self.bits
        for k in range(min(STEP, n)):
            word = at >> 5
            both = (words[word] << np.uint64(32)) | words[word + 1]
            key = (both >> (shift - (at & 31)).astype(np.uint64)) & mask
            out[k] = self.id[key]
            at += self.length[key]
            if k + 1 > (n - 1) % STEP and len(at):  # the last stretch has ended
                at[-1] = 0
        return out.T.reshape(-1)[:n]


def to_blocks(lengths, block_tokens: int):
    """Blocks of rows that follow each other in one file; a block is named by the place of its first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, codes = lengths.value, canonical(lengths.value)
        held: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([ids_of(raw, k) for _, _, _, k, raw in held])
            bits, points = pack(ids, size, codes)
            columns = [pa.array([held[0][1]], pa.int32()), pa.array([held[0][2]], pa.int64()), pa.array([[x[0] for x in held]], pa.list_(pa.int64())), pa.array([[x[3] for x in held]], pa.list_(pa.int32())), pa.array([points.tolist()], pa.list_(pa.int64())), pa.array([bits], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["file", "block", "doc_ids", "lengths", "points", "bits"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "file", "nth", "n_tokens", "ids")], strict=True):
                if held and (n >= block_tokens or row[1] != held[-1][1] or row[2] != held[-1][2] + 1):
                    yield flush()
                    n, held = 0, []
                held.append(row)
                n += row[3]
        if held:
            yield flush()

    return run


def from_blocks(lengths):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths.value)
        for batch in batches:
            for b in batch.to_pylist():
                n = np.array(b["lengths"], np.int64)
                raw = decoder.unpack(b["bits"], np.array(b["points"], np.int64), int(n.sum())).astype("<u4").tobytes()
                ends = 4 * np.cumsum(n)
                crc = [zlib.crc32(raw[e - 4 * k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
                k = len(n)
                yield pa.RecordBatch.from_arrays([pa.array(b["doc_ids"], pa.int64()), pa.array([b["file"]] * k, pa.int32()), pa.array([b["block"]] * k, pa.int64()), pa.array(range(k), pa.int32()), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "file", "block", "nth", "before", "n_tokens", "ids_crc32"])

    return run


def write(docs: DataFrame, tokenizer: str, path: str, block_tokens: int = 1 << 20) -> None:
    """Writes path/blocks (ids of all texts in ascending doc_id order, each with END_ID last) and path/code (a length for each id)."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_at"))
    ordered = texts.repartitionByRange(n, "doc_id", "_at").sortWithinPartitions("doc_id", "_at").select("doc_id", "text")
    with batches_of(spark, BATCH):
        encoded = materialize(ordered.mapInArrow(to_ids(tokenizer), IDS))
    ids = encoded.filter("file >= 0")
    counts = encoded.filter("file < 0").select("ids").mapInArrow(id_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    top = counts.collect()  # a row for each id of the vocabulary at most
    total = np.zeros(max((r[0] for r in top), default=0) + 1, np.int64)
    for i, k in top:
        total[i] = k
    lengths = code_lengths(total)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    sent = spark.sparkContext.broadcast(lengths)
    with batches_of(spark, BATCH):
        ids.mapInArrow(to_blocks(sent, block_tokens), BLOCK).write.parquet(f"{path}/blocks")


def read(spark, path: str) -> DataFrame:
    """What the files say of each document: doc_id, start, n_tokens, ids_crc32, with file, block and nth, its place in them."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first()[0]), np.uint8)
    sent = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    sizes = blocks.select("file", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = sizes.groupBy("file").agg(F.sum("n").alias("n")).select(F.col("file").alias("_file"), before(Window.orderBy("file")).alias("_first"))
    inner = sizes.select("file", "block", before(Window.partitionBy("file").orderBy("block")).alias("_inner"))
    first = inner.join(files, F.col("file") == F.col("_file")).select("_file", F.col("block").alias("_block"), (F.col("_first") + F.col("_inner")).alias("_start"))
    docs = blocks.mapInArrow(from_blocks(sent), READ)
    placed = docs.join(first, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return placed.select("doc_id", (F.col("_start") + F.col("before")).cast("long").alias("start"), "n_tokens", "ids_crc32", "file", "block", "nth")


def write_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encodes, writes and reads back. A null text is empty: its one id is END_ID.

    Rows that share a doc_id are documents of their own, in order of their texts' hashes;
    a null doc_id comes first; an empty table gives no rows; other columns are ignored.
    """
    from martloom.llm.common import shared_dir

    path = shared_dir(docs.sparkSession)
    write(docs, tokenizer or default_tokenizer(), path)
    return read(docs.sparkSession, path)


def query(spark, sf_dir: str) -> DataFrame:
    return write_and_read(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")
