"""Quality rules: per-text measures, and frequent lines across the documents of a host. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
NOT_WORD = r"[\x20\x09-\x0D]+"
SYMBOL = r"[^#*$%&|<>]+"


def let(value: Column, body) -> Column:
    """body(value) with value worked out once a row, not once for each use inside a lambda."""
    return F.transform(F.array(value), body)[0]


def count(array: Column) -> Column:
    return F.size(array).cast("long")


def words(text: Column) -> Column:
    return F.filter(F.split(text, NOT_WORD, -1), lambda w: w != "")


def repeated_words(tokens: Column, width: int = 3) -> Column:
    """Words inside windows of width words that occur at least twice, the first occurrence included.

    Windows are sorted by hash, so equal ones are neighbours; the places of those with an
    equal neighbour are sorted again, and each covers the words up to the next, width at most.
    """

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last")),
            lambda s, p: F.struct((s["n"] + F.least(F.lit(width), p - s["last"])).cast("long").alias("n"), p.alias("last")),
            lambda s: s["n"],
        )

    def places(sorted_windows: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            n = F.size(sorted_windows)
            before = (i > 0) & (F.get(sorted_windows, i - 1)["h"] == x["h"])
            after = (i < n - 1) & (F.get(sorted_windows, i + 1)["h"] == x["h"])
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        return F.sort_array(F.transform(F.filter(sorted_windows, twin), lambda x: x["i"]))

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - width)
        return F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(width)]).alias("h"), i.alias("i"))))

    return F.when(count(tokens) < width + 1, F.lit(0).cast("long")).otherwise(let(let(let(tokens, windows), places), covered))


def line_key(line: Column) -> Column:
    """Hash of a line without case, digits and differences of white space."""
    return F.xxhash64(F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), NOT_WORD, " ")))


def measures(docs: DataFrame) -> DataFrame:
    """A row for each document: the base measures, and its lines that have words as (k: key, n: words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("t"), "\n", -1), lambda x: x.rlike(WORD))
    d = docs.select("doc_id", F.col("source").alias("host"), text.alias("t"))
    d = d.select(
        "doc_id",
        "host",
        F.xxhash64("t").alias("content"),
        F.length(F.regexp_replace("t", NOT_WORD, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", SYMBOL, "")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(WORD)).cast("long").alias("n_words"),
        let(words(F.col("t")), lambda w: repeated_words(w)).alias("n_repeat_words"),
        let(lines, lambda x: F.struct(count(x).alias("n"), count(F.array_distinct(x)).alias("u"), F.transform(x, lambda y: F.struct(line_key(y).alias("k"), F.regexp_count(y, F.lit(WORD)).cast("long").alias("n"))).alias("lines"))).alias("l"),
    )
    return d.select("doc_id", "host", "content", "n_words", "word_chars", "n_symbols", (F.col("l.n") - F.col("l.u")).alias("n_dup_lines"), "n_repeat_words", F.col("l.lines").alias("lines"))


def frequent_lines(measured: DataFrame, min_docs: int, share: float) -> DataFrame:
    """Lines (host, key) that more than min_docs, and more than share of, a host's different texts have. Exact copies of a text count as one."""
    texts = measured.select("host", "content").distinct().groupBy(F.col("host").alias("_h")).agg(F.count("*").alias("_texts"))
    found = measured.select("host", "content", F.explode(F.array_distinct(F.transform("lines", lambda x: x["k"]))).alias("key")).distinct()
    counts = found.groupBy("host", "key").agg(F.count("*").alias("n_texts")).filter(F.col("n_texts") > min_docs)
    return counts.join(texts, F.col("host").eqNullSafe(F.col("_h"))).filter(F.col("n_texts") > share * F.col("_texts")).select("host", "key", "n_texts")


def judge(docs: DataFrame, min_docs: int = 20, share: float = 0.02, keep_share: float = 0.2) -> DataFrame:
    """Base measures of each document and its verdict.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows.
    Otherwise a document is kept if the words of its lines that aren't frequent at its
    host (frequent_lines) are at least keep_share of its words.

    A null or empty text has no words and fails; a null source is a host of its own; rows
    that share a doc_id are judged each for itself; an empty table gives no rows; other
    columns are ignored.
    """
    from martloom.llm.common import materialize

    measured = materialize(measures(docs).withColumn("row", F.monotonically_increasing_id()))
    frequent = frequent_lines(measured, min_docs, share).select(F.col("host").alias("_h"), F.col("key").alias("_k"))
    lines = measured.filter(F.size("lines") > 0).select("row", "host", F.explode("lines").alias("x"))
    removed = (
        lines.join(frequent, F.col("host").eqNullSafe(F.col("_h")) & (F.col("x.k") == F.col("_k")))
        .groupBy(F.col("row").alias("_row")).agg(F.sum("x.n").alias("n_line_words"))
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measured.drop("lines").join(removed, F.col("row") == F.col("_row"), "left").withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0)))
    out = out.withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("n_words") - F.col("n_line_words") >= keep_share * F.col("n_words"))
    return out.withColumn("kept", kept).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words")


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
w AS (SELECT doc_id, source, t, row, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS a FROM d),
g AS (SELECT row, i, a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] AS g FROM (SELECT row, a, unnest(range(1, len(a) - 1)) AS i FROM w)),
gg AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT row, count(DISTINCT i + k) AS n FROM gg, (VALUES (0), (1), (2)) v(k) GROUP BY row),
l AS (SELECT row, source, t, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS key,
        len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
      FROM (SELECT row, source, t, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM l GROUP BY row),
texts AS (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source),
freq AS (SELECT l.source, l.key FROM l JOIN texts ON l.source IS NOT DISTINCT FROM texts.source
         GROUP BY l.source, l.key, texts HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > 0.02 * texts),
rem AS (SELECT row, sum(n) AS n FROM l JOIN freq ON l.source IS NOT DISTINCT FROM freq.source AND l.key = freq.key GROUP BY row),
m AS (SELECT doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(rem.n, 0) AS BIGINT) AS n_line_words
      FROM w LEFT JOIN dup USING (row) LEFT JOIN rep USING (row) LEFT JOIN rem USING (row)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - n_line_words >= 0.2 * n_words AS kept, n_line_words FROM b
"""
