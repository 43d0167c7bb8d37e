"""Helpers shared by the text operators: shared-folder tables and vectorised word hashing.

Words are found and hashed for a whole Arrow slice at once: bytes are classed by a
table, word limits fall where the class changes, and a word's hash is a difference of
prefix sums of a polynomial modulo 2**64, mixed afterwards.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Characters of `[^\x20\x09-\x0D]+` as bytes of UTF-8.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Characters of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` as bytes of UTF-8.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C55
GRAM = 0xC2B2AE3D27D4EB4F
SLICE_BYTES = 1 << 19
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_powers: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder that the session names in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="martloom-")  # one process: its own disk is shared
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/martloom-{uuid.uuid4().hex}"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def materialize(df: DataFrame) -> DataFrame:
    """Writes a table in the shared folder and reads it back: lineage ends, lost executors lose nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Jobs run inside hand their rows to Python in batches of about size bytes; a longer row is a batch of its own."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, one after the other, and where each row starts; null is empty."""
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a slice take about limit bytes; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            below = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, below + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1024), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of values[i] * base**i before each place, with which any stretch can be hashed."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def stretch(sums: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = powers(pow(base, -1, 1 << 64), len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(GRAM))


class Words:
    """Words of a slice: byte limits (starts, ends) in raw, and of row i the words rows[i] to rows[i + 1]."""

    def __init__(self, column: pa.Array, kind: np.ndarray = SPACED, lower: bool = False) -> None:
        self.raw, self.at = text_bytes(column)
        if lower:
            self.raw = LOWER[self.raw]
        inside = kind[self.raw]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.at] = True
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.rows = np.searchsorted(self.starts, self.at)

    def hashes(self) -> np.ndarray:
        return stretch(prefix(self.raw.astype(np.uint64) + np.uint64(1), BASE), BASE, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_ends(self) -> np.ndarray:
        """For each word, where its row's words end."""
        return np.repeat(self.rows[1:], self.counts())

    def data(self) -> bytes:
        return self.raw.tobytes()


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place, as far as k fit in."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = 1
    for j in range(k):
        total += hashes[j : j + n] * np.uint64(factor)
        factor = factor * GRAM % (1 << 64)
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
