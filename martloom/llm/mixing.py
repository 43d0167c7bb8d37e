"""Mixing sources to target weights by capped water-filling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from martloom.llm.common import fresh, materialize

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """60 seeded bits of a document's id; a null id has its own."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def water_fill(sources: DataFrame, max_epochs: float) -> DataFrame:
    """Targets of sources (source, size, weight) that share the sum of all sizes by weight, each at most max_epochs times its size.

    Clamping the sources above their cap and sharing what is left by weight, again and
    again, ends where the level (target per weight) of the unclamped ones is below the
    cap per weight of each of them. Ordered by cap per weight, the clamped sources are
    the first ones, so running sums give the level for each number of clamped sources.
    The first source whose cap the level doesn't reach ends the clamped ones; from there on
    clamping more would only lower the level, so the right one is the highest that is below
    its source's cap. The window holds one row a source.
    """
    order = Window.orderBy("_limit", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = sources.withColumn("_cap", F.col("size") * F.lit(float(max_epochs))).withColumn("_limit", F.when(F.col("weight") > 0, F.col("_cap") / F.col("weight")).otherwise(F.lit(float("inf"))))
    s = s.withColumn("_all", F.sum("size").over(every)).withColumn("_weights", F.sum("weight").over(every))
    s = s.withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_used", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    left = F.greatest(F.col("_weights") - F.col("_used"), F.lit(1e-300))
    s = s.withColumn("_level", (F.col("_all") - F.col("_capped")) / left)
    s = s.withColumn("_clamped", F.col("_level") >= F.col("_limit"))
    s = s.withColumn("_final", F.max(F.when(~F.col("_clamped"), F.col("_level"))).over(every))
    target = F.when(F.col("_clamped") | F.col("_final").isNull(), F.col("_cap")).otherwise(F.col("_final") * F.col("weight"))
    return s.select("source", "size", "weight", F.least(target, F.col("_cap")).alias("target"))


def planned(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: int) -> DataFrame:
    """mix_plan with key, which tells the rows that share a doc_id apart, and text_key. Columns of its own only, so any of docs' names will do."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), seed).alias("draw"), F.xxhash64("text").alias("text_key"))
    sized = materialize(sized.withColumn("bin", F.pmod("draw", F.lit(BINS))))
    bins = sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    sources = bins.groupBy("source").agg(F.sum("bin_size").alias("size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    targets = water_fill(sources.withColumn("weight", weight), max_epochs).select(F.col("source").alias("_s"), F.col("size").alias("source_size"), "target")
    targets = targets.withColumn("_times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    targets = targets.withColumn("_whole", F.floor("_times")).withColumn("_part", F.col("target") - F.col("_whole") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.select(F.col("source").alias("_s"), F.col("bin").alias("_b"), F.coalesce(F.sum("bin_size").over(before), F.lit(0)).alias("_before"))
    placed = starts.join(targets.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t")
    in_bin = Window.partitionBy("source", "bin").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = sized.withColumn("_in", F.coalesce(F.sum("size").over(in_bin), F.lit(0)))
    out = run.join(placed, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bin") == F.col("_b")))
    copies = F.col("_whole") + F.when((F.col("_before") + F.col("_in") + F.col("size") / 2 <= F.col("_part")) & (F.col("_whole") < max_epochs), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_key")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """What a mix takes of each document: doc_id, source, size, source_size, target, copies, taken.

    Sources in code-point order, null last, weigh as weights repeat. A document is taken
    floor(target / source_size) times, and once more while the sizes before it in its
    source's seeded order stay below the remaining fraction, so a source misses its
    target by half a document at most. That order is kept by bins of the seeded draw:
    sums of bins, then running sums in a bin, so a hot source is spread over 4096 groups.

    A null text counts 0 words, a source of no words has target 0 and is taken 0 times,
    a null source is a source, rows of one doc_id are documents of their own, an empty
    table gives no rows; other columns are ignored.
    """
    return planned(docs, weights, max_epochs, seed).drop("text_key")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The mixed documents themselves, each row as often as the plan takes it, with its columns, whatever their names.

    Rows that share a doc_id, source and text share their copies: as many are given in
    all as the plan takes of them. Nulls and an empty table are as mix_plan has them.
    """
    k = {c: fresh(docs, f"mix_{c}") for c in ("id", "source", "text", "copies", "rows", "nth", "at")}
    plan = planned(docs, weights, max_epochs, seed).groupBy(F.col("doc_id").alias(k["id"]), F.col("source").alias(k["source"]), F.col("text_key").alias(k["text"])).agg(F.sum("copies").alias(k["copies"]), F.count("*").alias(k["rows"]))
    same = F.col("doc_id").eqNullSafe(F.col(k["id"])) & F.col("source").eqNullSafe(F.col(k["source"])) & (F.xxhash64("text") == F.col(k["text"]))
    taken = docs.join(plan.filter(F.col(k["copies"]) > 0), same)
    one, many = taken.filter(F.col(k["rows"]) == 1).withColumn(k["nth"], F.lit(1)), taken.filter(F.col(k["rows"]) > 1)
    twins = Window.partitionBy(k["id"], k["source"], k["text"]).orderBy(F.lit(0))
    each = one.unionByName(many.withColumn(k["nth"], F.row_number().over(twins)))
    share = F.floor(F.col(k["copies"]) / F.col(k["rows"])) + F.when(F.col(k["nth"]) <= F.col(k["copies"]) % F.col(k["rows"]), 1).otherwise(0)
    given = each.withColumn(k["copies"], share.cast("int")).filter(F.col(k["copies"]) > 0)
    return given.withColumn(k["at"], F.explode(F.sequence(F.lit(1), F.col(k["copies"])))).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS lim, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS weights FROM w),
v AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY lim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (weights - coalesce(sum(weight) OVER (ORDER BY lim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN level >= lim THEN cap ELSE least(cap, weight * max(CASE WHEN level < lim THEN level END) OVER ()) END AS target FROM v),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw % 4096, draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
c AS (SELECT r.doc_id, r.source, r.size, q.source_size, q.target,
        q.whole + CASE WHEN r.before + r.size / 2 <= q.target - q.whole * q.source_size AND q.whole < 3 THEN 1 ELSE 0 END AS copies
      FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM c
"""
