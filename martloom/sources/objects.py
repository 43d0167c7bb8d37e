"""Objects of exported JSON files, one by one.

A file is read in pieces that end at closing braces, by as many tasks as it has splits. What a
piece is depends on how many quotes and braces come before it in its file. So a first pass
gives the sums of each split, from which follows how every split begins; then each is read
from its own beginning. Objects that lie in one split are put together where they are
read; only what crosses from a split into the next is written and moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from martloom.sources.sinks import stored

#: A list under the key data, where the text begins at depth 1 or, after the first brace, at 0.
_DATA = r'"data"\s*:\s*\['
#: Up to a member that is an object: values of a list, and no key.
_MEMBER = r'(?:[^{}":]++|"(?:[^"\\]++|\\.)*+"(?!\s*:))*+\{'
DATA = re.compile(r"\s*\{[^{}]*" + _DATA + "|[^{}]*" + _DATA, re.A)
KEY = re.compile(r'[^{}]*"\s*:\s*\[', re.A)
FIRST_DATA = re.compile(r"^.*?" + _DATA, re.A | re.S)
MEMBER = re.compile(_DATA + _MEMBER + r"|^\s*," + _MEMBER, re.A | re.S)
#: Members that aren't objects: texts, numbers, commas.
OTHERS = re.compile(r'^(?:[^{"]++|"(?:[^"\\]++|\\.)*+")*+', re.S)


def _marks(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where pieces end, where quotes are that begin or end a text, and where braces open; what is escaped is neither."""
    n, wide = len(values), pa.types.is_large_string(values.type)
    _, at, data = values.buffers()
    ends = np.frombuffer(at, np.int64 if wide else np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    quotes, braces, slashes = (np.flatnonzero(text == ord(c)) for c in '"{\\')
    if len(slashes):
        last, escaped, limits = -1, [], set(ends.tolist())
        for p in slashes.tolist():
            if p != last and p + 1 not in limits:
                last = p + 1
                escaped.append(last)
        quotes, braces = np.setdiff1d(quotes, escaped, True), np.setdiff1d(braces, escaped, True)
    return ends[1:], quotes, braces


def _odd(quotes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(quotes, at) % 2


def _depths(values: pa.Array, quoted: int, depth: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Of each piece how deep it begins and how many braces it opens; and after all whether a text is open, and how deep it is."""
    ends, quotes, braces = _marks(values)
    braces = braces[_odd(quotes, braces) == quoted]
    opens = np.diff(np.searchsorted(braces, ends), prepend=0)
    after = depth + np.cumsum(opens - (_odd(quotes, ends) == quoted))
    return np.concatenate(([depth], after[:-1])), opens, (quoted + len(quotes)) % 2, int(after[-1])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array, dict]]:
    """Pieces of one split that follow one another: file and block, values, and the state that came with the first."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy(zero_copy_only=False)
        file = pc.dictionary_encode(batch.column("file")).indices.to_numpy()
        starts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (file[1:] != file[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            state = {c: batch.column(c)[a].as_py() for c in batch.schema.names if c != "value"}
            yield (state["file"], state["block"]), batch.column("value").slice(a, b - a), state


def _rows(schema: list[str], rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema)


SUMS = "file string, block long, odd int, outside long, inside long, is_list boolean"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split whether its quotes are odd, how much deeper it ends if it begins outside of a text or inside, and whether it begins a list."""
    found: dict[tuple[str, int], list] = {}
    for key, values, _ in _runs(batches):
        ends, quotes, braces = _marks(values)
        inner, closed = _odd(quotes, braces), _odd(quotes, ends)
        if key not in found:
            found[key] = [0, 0, 0, values[0].as_py().lstrip().startswith("[")]
        of = found[key]
        deeper = [int((inner == k).sum() - (closed == k).sum()) for k in (0, 1)]
        of[1 + of[0]] += deeper[0]
        of[2 - of[0]] += deeper[1]
        of[0] = (of[0] + len(quotes)) % 2
    yield _rows(["file", "block", "odd", "outside", "inside", "is_list"], [(*k, *v) for k, v in found.items()], [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()])


ROOTS = "file string, block long, has_data boolean, last boolean"


def _key_of(piece: str, depth: int) -> bool | None:
    """Whether a list begins here under the key data (True) or under another one (False)."""
    return True if depth in (0, 1) and DATA.match(piece) else False if KEY.match(piece) else None


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split whether it has a list under data, and of which kind its last key of a list is."""
    found: dict[tuple[str, int], list] = {}
    for key, values, state in _runs(batches):
        of = found.setdefault(key, [state["quoted"], state["depth"], False, None])
        depths, opens, of[0], of[1] = _depths(values, of[0], of[1])
        for i in np.flatnonzero(depths <= 1).tolist():
            kind = _key_of(values[i].as_py(), depths[i])
            of[2] = of[2] or bool(kind and depths[i] + opens[i] > 0)
            of[3] = of[3] if kind is None else kind
    yield _rows(["file", "block", "has_data", "last"], [(*k, *v[2:]) for k, v in found.items()], [pa.string(), pa.int64(), pa.bool_(), pa.bool_()])


FOUND = "file string, nth long, kind string, counts boolean, payload string"


class _Split:
    """A split on its way: what is read of an object that began before it, and of the one that is open."""

    def __init__(self, state: dict) -> None:
        if state["quoted"] is None:
            raise ValueError("the files have been split in another way since they were looked through: keep Spark's settings for files until the rows are read")
        self.file, self.block, self.n = state["file"], state["block"], 0
        self.quoted, self.depth, self.base, self.under, self.kind = (state[c] for c in ("quoted", "depth", "base", "under", "kind"))
        self.began, self.head, self.open = False, None, None

    def row(self, nth: int, counts: bool | None, texts: list[str]) -> tuple:
        return self.file, self.block + nth, self.kind, counts, "}".join(texts)

    def read(self, values: pa.Array, whole: bool) -> Iterator[tuple]:
        """Takes pieces, and gives the objects that begin and end in this split and count, if whole."""
        depths, opens, self.quoted, end = _depths(values, self.quoted, self.depth)
        base, pieces, first = self.base, values.to_pylist(), self.n
        self.depth, self.n = end, self.n + len(pieces)
        begins = (depths <= base) & (depths + opens > base)
        members = self.members(pieces, depths, begins) if base else None
        within = np.concatenate(([0], np.cumsum(depths > base)))
        starts = np.flatnonzero(begins).tolist()
        before = int(within[starts[0] if starts else len(pieces)])
        if before and self.open:
            self.open[2].extend(pieces[:before] if self.open[1] else [])
        elif before and not self.began:
            self.head = self.head or (first, None, [])
            self.head[2].extend(pieces[:before])
        if self.open and (before < len(pieces) or end <= base):
            if whole and self.open[1]:
                yield self.row(*self.open)
            self.open = None
        self.began = self.began or bool(starts)
        for i, j in list(zip(starts, [*starts[1:], len(pieces)], strict=False))[0 if whole else -1 :]:
            counts, ends = members is None or i in members, j < len(pieces) or end <= base
            if ends and not (whole and counts):
                continue
            inner = FIRST_DATA.sub("", pieces[i], count=1) if base else pieces[i]
            found = (first + i, counts, [OTHERS.sub("", inner, count=1), *pieces[i + 1 : i + 1 + int(within[j] - within[i + 1])]] if counts else [])
            if ends:
                yield self.row(*found)
            else:
                self.open = found

    def members(self, pieces: list[str], depths: np.ndarray, begins: np.ndarray) -> set[int]:
        """Which of the objects that begin follow [ or a comma of the list under data; another key's object or list doesn't begin one."""
        out = set()
        for i in np.flatnonzero(depths <= 1).tolist():
            kind = _key_of(pieces[i], depths[i])
            self.under = self.under if kind is None else kind
            if begins[i] and self.under and MEMBER.search(pieces[i]):
                out.add(i)
        return out

    def parts(self) -> Iterator[tuple]:
        """What belongs to objects that this split hasn't whole: the end of an earlier one, without counts, and the beginning of the last."""
        for x in (self.head, self.open):
            if x:
                yield self.row(*x)


def _split_rows(whole: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string()]
        names, split, at, out, size = ["file", "nth", "kind", "counts", "payload"], None, None, [], 0
        for key, values, state in _runs(batches):
            if key != at:
                out += split.parts() if split and not whole else []
                at, split = key, _Split(state)
            for row in split.read(values, whole):
                out.append(row)
                size += len(row[4])
                if size > 4_000_000:
                    yield _rows(names, out, kinds)
                    out, size = [], 0
        out += split.parts() if split and not whole else []
        yield _rows(names, out, kinds)

    return rows


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """The objects of exported files one by one: file, nth, kind and payload, with is_broken for those that aren't JSON.

    A file is read by as many tasks as it has splits, and none holds it whole. kind is list for
    members of a list, alone or under the key data, and single for a file that is one object.
    Members that aren't objects are left out. Where a text or an object doesn't end, the
    rest of the file is one broken object. nth orders the objects of a file.

    The files are looked through when this is called (twice, and once more for objects under
    data), and read when the rows are asked for. What is kept is a few rows a split.
    """
    pieces = spark.read.text(path, lineSep="}").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    sums = stored(pieces.mapInArrow(_sums, SUMS))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    splits = sums.withColumn("quoted", (F.coalesce(F.sum("odd").over(before), zero) % 2).cast("int"))
    splits = splits.withColumn("depth", F.coalesce(F.sum(F.when(F.col("quoted") == 1, F.col("inside")).otherwise(F.col("outside"))).over(before), zero))
    splits = stored(splits.select("file", "block", "quoted", "depth", F.first("is_list").over(every).alias("is_list")))
    beside = lambda of, how: pieces.join(F.broadcast(of), ["file", "block"], how)
    others = splits.filter("not is_list")
    roots = spark.createDataFrame([], ROOTS) if others.isEmpty() else stored(beside(others.drop("is_list"), "inner").select("value", "file", "block", "quoted", "depth").mapInArrow(_roots, ROOTS))
    known = splits.join(roots, ["file", "block"], "left")
    data = F.coalesce(F.max("has_data").over(every), F.lit(False)) & ~F.col("is_list")
    known = known.select("file", "block", "quoted", "depth", data.cast("int").alias("base"), F.last("last", True).over(before).alias("under"), F.when(F.col("is_list") | data, "list").otherwise("single").alias("kind"))
    known = stored(known)
    read = lambda whole: beside(known, "left").select("value", "file", "block", "quoted", "depth", "base", "under", "kind").mapInArrow(_split_rows(whole), FOUND)
    parts = stored(read(False))
    upto = Window.partitionBy("file").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("of", F.last(F.when(F.col("counts").isNotNull(), F.struct("nth", "counts")), True).over(upto)).filter("of.counts")
    g = parts.groupBy("file", F.col("of.nth").alias("nth"), "kind").agg(F.array_join(F.sort_array(F.collect_list(F.struct("nth", "payload")))["payload"], "}").alias("payload"))
    rows = read(True).drop("counts").unionByName(g).withColumn("payload", F.concat("payload", F.lit("}")))
    return rows.withColumn("is_broken", F.try_parse_json("payload").isNull())
