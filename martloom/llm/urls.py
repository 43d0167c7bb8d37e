"""URL filter: rules, hosts, url prefixes and words as sorted arrays of 64-bit digests, memory-mapped and probed by binary search.

The list is given, as a table of any size and as rules, not taken from the pages. An entry
with a / is a rule (host and start of the path), one that starts with * a word of a host's
labels, any other a host with its subdomains. Every verdict comes from the array.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.llm.common import materialize, table

#: (host, path) and verdict; a path starts and ends with /.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words that block a host which has one of them between the dots and hyphens of its name.
BLOCKED_WORDS = ("casino", "adult", "porn", "spam", "pills", "bets", "poker", "viagra", "ads")
#: Before an entry that stands for all hosts with this word between the dots and hyphens of their names.
WORD_MARK = "*"
SHARD_ENTRIES = 1 << 20


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both are empty for a null url and one without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(_url, instr(_url, '://') + 3)"))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def keys(host: Column, path: Column, depth: int) -> Column:
    """All entries that fit a url: each suffix of the host at a dot, alone (a blocked host) and with each start of the path of at most depth slashes, and the host's words."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    none = F.array().cast("array<string>")
    pieces = F.split(path, "/", -1)
    starts = F.transform(F.sequence(F.lit(1), F.least(F.size(pieces) - 1, F.lit(depth))), lambda i: F.concat(F.array_join(F.slice(pieces, 1, i), "/"), F.lit("/")))
    starts = F.when(path.startswith("/") & F.lit(depth > 0), starts).otherwise(none)
    words = F.transform(F.array_distinct(F.split(host, "[.-]", -1)), lambda w: F.concat(F.lit(WORD_MARK), w))
    return F.concat(F.flatten(F.transform(suffixes, lambda s: F.concat(F.array(s), F.transform(starts, lambda p: F.concat(s, p))))), words)


def entries(spark, rules, listed: DataFrame | None) -> DataFrame:
    """The list as rows (entry, verdict). Of entries given twice the first of the rules' verdicts stays, else allow before block."""
    given = spark.createDataFrame([(h, v, i) for i, (h, v) in enumerate(rules)], "entry string, verdict string, n long")
    if listed is not None:
        given = given.unionByName(listed.select("entry", "verdict", F.lit(1 << 40).alias("n")))
    kept = given.filter(f"entry is not null and verdict is not null and entry not in ('', '{WORD_MARK}')")
    return kept.groupBy("entry").agg(F.min(F.struct("n", "verdict"))["verdict"].alias("verdict"))


class DigestArray:
    """Sorted digests in a memory-mapped file of the task's own temporary folder, with the full strings to tell collisions."""

    def __init__(self, strings: list[str], verdicts: list[str]) -> None:
        digests = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        order = np.argsort(digests, kind="stable")
        self.strings, self.verdicts = [strings[i] for i in order], [verdicts[i] for i in order]
        handle, path = tempfile.mkstemp(suffix=".digests")
        with os.fdopen(handle, "wb") as f:
            f.write(digests[order].tobytes())
        self.digests = np.memmap(path, np.uint64, "r", shape=len(strings)) if strings else np.zeros(0, np.uint64)
        os.unlink(path)  # the mapping keeps the pages

    def probe(self, wanted: list[str]) -> list[int]:
        """Place of each string, or -1."""
        asked = np.fromiter(map(xxhash.xxh64_intdigest, wanted), np.uint64, len(wanted))
        at = np.searchsorted(self.digests, asked)
        out = np.full(len(wanted), -1)
        for i in np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == asked)) if len(self.digests) else ():
            j = at[i]
            while j < len(self.strings) and self.digests[j] == asked[i]:
                if self.strings[j] == wanted[i]:
                    out[i] = j
                    break
                j += 1
        return out.tolist()


def found_in(shard_rows) -> object:
    """Probes the keys of a shard against its part of the list. Both come as one stream, the list first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings: list[str] = []
        verdicts: list[str] = []
        array = None
        for batch in batches:
            key, verdict = batch.column("key").to_pylist(), batch.column("verdict").to_pylist()
            n = next((i for i, v in enumerate(verdict) if v is None), len(verdict))
            strings += key[:n]
            verdicts += verdict[:n]
            if n == len(key):
                continue
            array = array or DigestArray(strings, verdicts)
            asked = key[n:]
            hits = [(k, array.verdicts[j]) for k, j in zip(asked, array.probe(asked), strict=True) if j >= 0]
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.string()), pa.array([h[1] for h in hits], pa.string())], ["key", "verdict"])

    return run


def judge(pages: DataFrame, rules, listed: DataFrame | None = None, shards: int | None = None) -> DataFrame:
    """Verdict of each url: the longest rule that fits, else block if its host, a domain above it or a word of its name is listed to be blocked, else allow.

    rules are pairs of entry and verdict, listed is a table of them (entry, verdict: allow or
    block; null ones are left out). The list and the different keys of all urls are dealt by digest; a shard's part of
    the list becomes its digest array. A url's keys go no deeper than the deepest rule, and
    are made distinct before they are dealt, so a hot host costs a shard one probe.

    A null url, or one without ://, has an empty host and path, fits nothing and is
    allowed. Rows that share a page_id stay rows of their own, other columns are
    ignored, an empty list or table is no error.
    """
    spark = pages.sparkSession
    p = pages.select("page_id", F.col("url").alias("_url"))
    host, path = parts(F.col("_url"))
    p = p.select("page_id", host.alias("host"), path.alias("path"))
    every = materialize(entries(spark, rules, listed))
    slashes = F.length("entry") - F.length(F.replace("entry", F.lit("/")))
    depth, n = every.agg(F.coalesce(F.max(slashes), F.lit(0)), F.count("*")).first()
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SHARD_ENTRIES))
    whole = F.regexp_extract("path", f"^((?:[^/]*/){{0,{max(depth, 1)}}})", 1)  # as far as rules tell paths apart
    places = p.select("host", whole.alias("dir")).distinct()
    wanted = places.select(F.explode(keys(F.col("host"), F.col("dir"), depth)).alias("key")).distinct()
    both = every.select(F.col("entry").alias("key"), "verdict").unionByName(wanted.withColumn("verdict", F.lit(None).cast("string")))
    dealt = both.repartition(shards, F.xxhash64("key")).sortWithinPartitions(F.col("verdict").isNull())
    hits = materialize(dealt.mapInArrow(found_in(None), "key string, verdict string"))
    is_rule = F.col("key").contains("/")
    judged = (
        places.select("host", "dir", F.explode(keys(F.col("host"), F.col("dir"), depth)).alias("key"))
        .join(hits, "key")
        .groupBy(F.col("host").alias("_host"), F.col("dir").alias("_dir"))
        .agg(F.max_by(F.struct("key", "verdict"), F.when(is_rule, F.length("key"))).alias("rule"), F.max(~is_rule & (F.col("verdict") == "block")).alias("listed"))
    )
    out = p.withColumn("dir", whole).join(judged, (F.col("host") == F.col("_host")) & (F.col("dir") == F.col("_dir")), "left")
    verdict = F.coalesce(F.col("rule.verdict"), F.when(F.col("listed"), F.lit("block")), F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("rule.key").alias("rule"), verdict.alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    words = spark.createDataFrame([(WORD_MARK + w, "block") for w in BLOCKED_WORDS], "entry string, verdict string")
    return judge(pages, RULES, words)


SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, d, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, arg_max(h || d, length(h || d)) AS rule, arg_max(v, length(h || d)) AS v
      FROM q JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, d) GROUP BY page_id)
SELECT q.page_id, host, path, rule, coalesce(v, CASE WHEN regexp_matches(host, '(^|[.-])(casino|adult|porn|spam|pills|bets|poker|viagra|ads)([.-]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN m ON q.page_id = m.page_id
"""
