"""Running sums and maxima that don't bring a key's rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, key: str, part: str, order: list, values: dict[str, tuple[str, Column, bool]]) -> DataFrame:
    """Sums or maxima of each key's rows up to every row, or before it if the last of (kind, value, itself) is false.

    They are taken within the rows of one part of a key, by order, and over the totals of
    its lower parts, of which a key has a row each. A sum of nothing is 0, a maximum null.
    """
    fold = {"sum": F.sum, "max": F.max}
    first = Window.unboundedPreceding
    # One column for key and part, never null: the join finds the rows dealt and sorted as the window left them.
    rows_of = rows.withColumn("_k", F.struct(F.col(key).alias("p"), F.col(part).alias("d")))
    within = Window.partitionBy("_k").orderBy(*order)
    local = rows_of.select("*", *[fold[kind](value).over(within.rowsBetween(first, 0 if itself else -1)).alias(f"_in_{n}") for n, (kind, value, itself) in values.items()])
    totals = rows_of.groupBy(F.col("_k").alias("_of")).agg(*[fold[kind](value).alias(f"_of_{n}") for n, (kind, value, _) in values.items()])
    past = Window.partitionBy("_of.p").orderBy("_of.d").rowsBetween(first, -1)
    before = totals.select("_of", *[fold[kind](f"_of_{n}").over(past).alias(f"_before_{n}") for n, (kind, _, _) in values.items()])
    both = local.join(before, F.col("_k") == F.col("_of"))
    zero = F.lit(0)
    join = {"sum": lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero), "max": lambda a, b: F.greatest(a, b)}
    return both.select(*rows.columns, *[join[kind](F.col(f"_in_{n}"), F.col(f"_before_{n}")).alias(n) for n, (kind, _, _) in values.items()])
