"""Conversation prefix trie: node tables addressed by minimal perfect hashes, one for each range of the sorted conversations.

A turn is known by a digest of its role and text, a prefix by a digest chained over its
turns, and a conversation by all its prefixes' digests in a row. Conversations are dealt by
ranges of that key, copies by conv_id as well, so that the members of a node lie next to
each other. A range is a shard: its distinct prefixes get slots by a minimal perfect hash,
each lookup compares the digest in the slot, counts are scattered into flat arrays, and sums
over subtrees go up through the array of parents' slots, deepest nodes first.

Only prefixes of a shard's first or last key can have members elsewhere. These border nodes,
twice the depth of a conversation at most from each shard, are added up over shards by
digest; each is then counted towards its ancestors in one shard that holds it, by the same
sums over parents' slots, and these are added up again. All other nodes are whole where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import materialize, mix, table

#: Turns of a shard, on average, and ids that a row of a border node's ends holds.
SHARD_TURNS, ENDS_ROW = 400_000, 1024
DIGEST = 16
LEVELS = 64

KEYED = "conv_id long, key binary, sizes binary, depth int"
NODES = "shard int, digest binary, parent binary, conv_id long, depth long, size long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"
SUMS = "digest binary, leaves long, saved long"
LONG, BIN = pa.int64(), pa.binary()


class Slots:
    """A minimal perfect hash of different digests (two halves each): a key's slot is its rank among those that have a place of a level's bits to themselves; the others go on to the next level."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, used = np.arange(len(a)), 0
        slot = np.empty(len(a), np.int64)
        while len(left) and len(self.levels) < LEVELS:
            size = len(left) + len(left) // 2 + 1
            at = self._places(a[left], b[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = used + np.cumsum(alone) - 1
            self.levels.append((alone, rank))
            placed = alone[at]
            slot[left[placed]] = rank[at[placed]]
            used += int(placed.sum())
            left = left[~placed]
        slot[left] = used + np.arange(len(left))
        self.rest = {(int(a[i]), int(b[i])): int(slot[i]) for i in left}
        self.a, self.b = np.empty_like(a), np.empty_like(b)
        self.a[slot], self.b[slot] = a, b

    @staticmethod
    def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a ^ mix(b + np.uint64(level))) % np.uint64(size)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of digests; -1 for one that the slot it leads to doesn't hold."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            if not len(left):
                break
            at = self._places(a[left], b[left], level, len(alone))
            hit = alone[at]
            slot = rank[at[hit]]
            who = left[hit]
            same = (self.a[slot] == a[who]) & (self.b[slot] == b[who])
            out[who[same]] = slot[same]
            left = left[~hit]
        for i in left if self.rest else ():
            out[i] = self.rest.get((int(a[i]), int(b[i])), -1)
        return out


def halves(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    two = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    return two[:, 0].copy(), two[:, 1].copy()


def different(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def climb(parent: np.ndarray, depth: np.ndarray, values: list[np.ndarray]) -> None:
    """Adds each node's values to its parent's, deepest nodes first; nodes of depth 0 have no parent."""
    order = np.argsort(-depth, kind="stable")
    limits = np.flatnonzero(np.diff(depth[order])) + 1
    for nodes in np.split(order, limits):
        if len(nodes) and depth[nodes[0]] > 0:
            for v in values:
                np.add.at(v, parent[nodes], v[nodes])


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of rebuilt conversations: the digests of all their prefixes, shortest first."""
    for batch in batches:
        keys, sizes, depths = [], [], []
        for digests, n in zip(batch.column("digests").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
            last, key = b"", []
            for d in digests:
                last = hashlib.blake2b(last + d, digest_size=DIGEST).digest()
                key.append(last)
            keys.append(b"".join(key))
            sizes.append(np.array(n, np.int64).tobytes())
            depths.append(len(key))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(keys, BIN), pa.array(sizes, BIN), pa.array(depths, pa.int32())], ["conv_id", "key", "sizes", "depth"])


def decimal_ids(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def node_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard. Those of its borders have a digest, no parent_conv_id, sums over the others only, and their ends as rows of ids."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    given = pa.Table.from_batches(batches) if (batches := [b for b in batches if b.num_rows]) else None
    if given is None:
        return
    conv = given.column("conv_id").to_numpy()
    keys = given.column("key").to_pylist()
    deep = given.column("depth").to_numpy().astype(np.int64)
    a, b = halves(b"".join(keys))
    size_of = np.frombuffer(b"".join(given.column("sizes").to_pylist()), np.int64)
    slots = Slots(*different(a, b))
    root = len(slots.a)
    slot = slots.find(a, b)
    if (slot < 0).any():
        raise ValueError("a prefix has no slot")
    ends = np.cumsum(deep)
    first = np.zeros(len(slot), bool)
    first[(ends - deep)[deep > 0]] = True
    above = np.where(first, root, np.append(root, slot)[: len(slot)])
    who = np.repeat(np.arange(len(conv)), deep)
    depth, size, parent = (np.zeros(root + 1, np.int64) for _ in range(3))
    depth[slot] = np.arange(len(slot)) - (ends - deep)[who] + 1
    size[slot], parent[slot] = size_of, above
    count = np.bincount(slot, minlength=root + 1)
    count[root] = len(conv)
    least = np.full(root + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, slot, conv[who])
    least[root] = conv.min()
    border = np.zeros(root + 1, bool)
    border[root] = True
    for key in (min(keys), max(keys)):
        border[slots.find(*halves(key))] = True
    inside = np.flatnonzero(~border)
    children = np.bincount(parent[inside], minlength=root + 1)
    leaves = np.where(border, 0, children == 0).astype(np.int64)
    saved = np.where(border, 0, (count - 1) * size)
    climb(parent, depth, [leaves, saved])
    at_end = np.full(len(conv), root)
    at_end[deep > 0] = slot[ends[deep > 0] - 1]
    order = np.lexsort((conv, at_end))
    ended, limit = np.unique(at_end[order], return_index=True)
    members = dict(zip(ended.tolist(), np.split(conv[order], limit[1:]), strict=True))
    empty = hashlib.sha256().digest()
    name = lambda i: bytes(DIGEST) if i == root else slots.a[i].tobytes() + slots.b[i].tobytes()
    columns = NODES.replace(",", "").split(" ")[::2]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int32(), BIN, BIN, *[LONG] * 8, BIN]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], columns)

    for part in np.split(inside, range(20_000, len(inside), 20_000)):
        hashes = [hashlib.sha256(decimal_ids(members[i])).digest() if i in members else empty for i in part.tolist()]
        known = ~border[parent[part]]
        above = [None if k else name(p) for k, p in zip(known.tolist(), parent[part].tolist(), strict=True)]
        arrays = [pa.array(np.full(len(part), shard), pa.int32()), pa.nulls(len(part), BIN), pa.array(above, BIN), pa.array(least[part]), pa.array(depth[part]), pa.array(size[part]), pa.array(least[parent[part]], mask=~known)]
        arrays += [pa.array(x[part].astype(np.int64)) for x in (count, children, leaves, saved)] + [pa.array(hashes, BIN)]
        yield pa.RecordBatch.from_arrays(arrays, columns)
    for i in np.flatnonzero(border).tolist():
        own = (shard, name(i), None if i == root else name(int(parent[i])), int(least[i]), int(depth[i]), int(size[i]), None)
        ids = members.get(i, np.zeros(0, np.int64))
        rows = [(*own, int(count[i]), int(children[i]), int(leaves[i]), int(saved[i]), None)]
        rows += [(*own[:3], int(ids[k]), *[None] * 7, ids[k : k + ENDS_ROW].tobytes()) for k in range(0, len(ids), ENDS_ROW)]
        yield batch(rows)


def border_sums(t: pa.Table) -> pa.Table:
    """What the border nodes of a shard that are counted there add to their ancestors and themselves."""
    a, b = halves(b"".join(t.column("digest").to_pylist()))
    slots = Slots(a, b)
    slot = slots.find(a, b)
    depth, parent, leaves, saved = (np.zeros(len(slot), np.int64) for _ in range(4))
    depth[slot], leaves[slot], saved[slot] = (t.column(c).to_numpy() for c in ("depth", "own_leaves", "own_saved"))
    below = np.flatnonzero(t.column("depth").to_numpy() > 0)
    parent[slot[below]] = slots.find(*halves(b"".join(t.column("parent").take(pa.array(below)).to_pylist())))
    climb(parent, depth, [leaves, saved])
    return pa.table([t.column("digest"), pa.array(leaves[slot]), pa.array(saved[slot])], ["digest", "leaves", "saved"])


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, whose rows come in order."""
    name, state = None, hashlib.sha256()
    for batch in batches:
        done = []
        for digest, raw in zip(batch.column("digest").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if digest != name:
                done += [(name, state.digest())] if name is not None else []
                name, state = digest, hashlib.sha256()
            else:
                state.update(b",")
            state.update(decimal_ids(np.frombuffer(raw, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in done], BIN), pa.array([s for _, s in done], BIN)], ["digest", "sha"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], BIN), pa.array([state.digest()], BIN)], ["digest", "sha"])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Conversations that begin like the first of their hundred: conv_id, digests and sizes (code points of the text) of their turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.length(text).cast("long").alias("size")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    heads = own.filter(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6)).cast("int")
    kept = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    both = own.join(heads, F.col("conv_id") - F.col("conv_id") % 100 == F.col("base"), "left").withColumn("all", F.when(F.col("head").isNull(), kept).otherwise(F.concat(F.slice("head", 1, h), kept)))
    return both.select("conv_id", F.col("all.digest").alias("digests"), F.col("all.size").alias("sizes"))


def nodes(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of sequences (conv_id, digests array<binary>, sizes array<long>): one row a node.

    conv_id is the smallest member, parent_conv_id the parent's (root: null), depth the
    number of turns, n_convs the members, n_children and n_leaves the children and the
    childless nodes of the subtree, saved_tokens the sum of (n_convs - 1) times size over it,
    ends_sha256 the hash of the ids of members that end there. conv_ids differ and aren't
    null; a sequence without turns ends at the root. An empty table gives no rows. A
    conversation is held in one row; nodes are told apart by digests of 128 bits.
    """
    spark = sequences.sparkSession
    keyed = materialize(sequences.select(F.col("conv_id").cast("long").alias("conv_id"), "digests", F.col("sizes").cast("array<long>").alias("sizes")).mapInArrow(chained, KEYED))
    turns = keyed.agg(F.coalesce(F.sum("depth") + F.count("*"), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))
    found = materialize(keyed.repartitionByRange(shards, "key", "conv_id").mapInArrow(node_table, NODES))
    inside, edge = found.filter("digest is null"), found.filter("digest is not null and depth is not null")
    merged = edge.groupBy("digest").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("size").alias("size"), F.min("conv_id").alias("conv_id"), F.min("shard").alias("home"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    merged = materialize(merged)
    more = merged.filter("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("more"))
    merged = merged.join(more, "digest", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    here = F.col("home") == F.col("shard")
    own = edge.select("shard", "digest", "parent", "depth").join(merged.select("digest", "home", "n_children", "n_convs", "size"), "digest")
    own = own.select("shard", "digest", "parent", "depth", F.when(here & (F.col("n_children") == 0), 1).otherwise(0).alias("own_leaves"), F.when(here, (F.col("n_convs") - 1) * F.col("size")).otherwise(0).alias("own_saved"))
    sums = own.groupBy("shard").applyInArrow(border_sums, SUMS).groupBy("digest").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    ends = found.filter("digest is not null and depth is null").select("digest", "shard", "conv_id", "ends")
    hashed = ends.repartition("digest").sortWithinPartitions("digest", "shard", "conv_id").drop("shard", "conv_id").mapInArrow(joined_ids, "digest binary, sha binary")
    above = merged.select(F.col("digest").alias("parent"), F.col("conv_id").alias("above"))
    borders = merged.join(sums, "digest").join(hashed, "digest", "left").join(above, "parent", "left")
    borders = borders.select("conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", (F.col("n_leaves") + F.col("leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"), F.coalesce(F.lower(F.hex("sha")), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.lower(F.hex("ends")).alias("ends_sha256")]
    local = edge.select("shard", F.col("digest").alias("parent")).join(above, "parent")
    under = inside.filter("parent is not null").drop("parent_conv_id").join(local.withColumnRenamed("above", "parent_conv_id"), ["shard", "parent"])
    return inside.filter("parent is null").select(*columns).unionByName(under.select(*columns)).unionByName(borders)


def trie(conversations: DataFrame) -> DataFrame:
    """nodes() of conversations rebuilt by rebuilt().

    Turns go by turn, null first; those of one number, repeats included, by a digest of
    role and text. Null role or text is empty. Rows without conv_id belong to nothing.
    Other columns are ignored. An empty table gives no rows.
    """
    return nodes(rebuilt(conversations))


def query(spark, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 6 AS h FROM ids),
t AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(g ORDER BY turn NULLS FIRST, g) AS g, list(n ORDER BY turn NULLS FIRST, g) AS n FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.g[1:h], []), c.g[h + 1:]) AS g, list_concat(coalesce(b.n[1:h], []), c.n[h + 1:]) AS n
      FROM c JOIN h USING (conv_id) LEFT JOIN c AS b ON b.conv_id = c.conv_id - c.conv_id % 100),
p AS (SELECT conv_id, d, coalesce(array_to_string(g[1:d], ''), '') AS k, d = len(g) AS ends, coalesce(n[d], 0) AS n FROM (SELECT *, unnest(range(len(g) + 1)) AS d FROM r)),
nodes AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY k, d),
kids AS (SELECT left(k, len(k) - 32) AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
own AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
sums AS (SELECT p.k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * own.n) AS saved_tokens FROM own JOIN p ON p.conv_id = own.conv_id AND p.d <= own.d GROUP BY p.k)
SELECT own.conv_id, own.d AS depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, own.ends_sha256
FROM own JOIN sums USING (k) LEFT JOIN nodes AS up ON own.d > 0 AND up.k = left(own.k, len(own.k) - 32)
"""
