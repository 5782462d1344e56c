"""Prefix sums and numbers over a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigwright.runtime import Cut, shuffle_partitions


def prefix_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column], few: bool = False) -> DataFrame:
    """rows with, for each name of ``sums``, the sum of its column over all rows before in ``order``, 0 for the first.

    Rows are sorted into ranges; only the sums of ranges, one row each, meet in one place. few: the caller has counted the
    rows and found few (thousands), so that one task may sort them.
    """
    names = list(sums)
    zero = lambda n: F.lit(0).cast(rows.select(sums[n].alias("x")).schema["x"].dataType)
    if few:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.select("*", *(F.coalesce(F.sum(c).over(before), zero(n)).alias(n) for n, c in sums.items()))
    valued = rows.select("*", *(c.alias(f"__{n}") for n, c in sums.items()))
    ranged = Cut(valued.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).withColumn("__range", F.spark_partition_id()), "ranged").df
    totals = ranged.groupBy("__range").agg(*(F.sum(f"__{n}").alias(f"__total_{n}") for n in names))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__range", *(F.sum(f"__total_{n}").over(earlier).alias(f"__before_{n}") for n in names))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("*", *(F.sum(f"__{n}").over(inside).alias(f"__inside_{n}") for n in names)).join(F.broadcast(before), "__range")
    return placed.select(*(F.col(f"`{c}`") for c in rows.columns), *((F.coalesce(f"__inside_{n}", zero(n)) + F.coalesce(f"__before_{n}", zero(n))).alias(n) for n in names))
