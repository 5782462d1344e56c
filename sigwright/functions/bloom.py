"""Sizing of Bloom filters in closed form, filters as tables of bitmaps, and Spark's own filter on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LN2_SQUARED = math.log(2) ** 2


def bytes_for(capacity: Column, fp: Column) -> Column:
    """Bytes that hold ``capacity`` items at a false positive rate; null unless both are above 0."""
    bits = F.ceil(-(capacity * F.log(fp)) / LN2_SQUARED)
    return F.when((capacity > 0) & (fp > 0), F.ceil(bits / 8.0).cast("long"))


def hashes_for(n_bytes: Column, capacity: Column) -> Column:
    """The best number of hashes; null unless both are above 0."""
    return F.when((capacity > 0) & (n_bytes > 0), F.round(F.lit(math.log(2)) * (n_bytes * 8) / capacity).cast("int"))


def rate_for(n_bytes: Column, capacity: Column) -> Column:
    """False positive rate at the best number of hashes; null unless both are above 0."""
    return F.when((capacity > 0) & (n_bytes > 0), F.exp(-(n_bytes * 8.0 / capacity) * LN2_SQUARED))


def capacity_for(n_bytes: Column, fp: Column) -> Column:
    """Items that fit at a false positive rate; null unless both are above 0."""
    return F.when((n_bytes > 0) & (fp > 0), F.floor(-(n_bytes * 8 / F.log(fp) * LN2_SQUARED)).cast("long"))


def probe_positions(value: Column, hashes: int, bits: int) -> Column:
    """array<long> of the places of a value: a linear combination of two 60-bit halves of its MD5 digest."""
    half = lambda at: F.pmod(F.conv(F.substr(F.md5(value.cast("string").cast("binary")), F.lit(at), F.lit(15)), 16, 10).cast("long"), F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(half(1) + i * half(16), F.lit(bits)))


def size_for(capacity: int, fp: float) -> tuple[int, int]:
    """(bits, hashes) of a filter for so many items at a false positive rate."""
    bits = 8 * math.ceil(math.ceil(-capacity * math.log(fp) / LN2_SQUARED) / 8)
    return bits, max(1, round(math.log(2) * bits / capacity))


def filter_table(df: DataFrame, column: str, capacity: int, fp: float = 0.001) -> DataFrame:
    """(bucket, bitmap): a Bloom filter of a column's values, cut into bitmaps of 4 KB that tasks make and merge, so
    that no task holds the whole. Nulls are left out."""
    bits, hashes = size_for(capacity, fp)
    places = df.filter(F.col(column).isNotNull()).select(F.explode(probe_positions(F.col(column), hashes, bits)).alias("p"))
    return places.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))


def maybe_members(df: DataFrame, column: str, bitmaps: DataFrame, capacity: int, fp: float = 0.001) -> DataFrame:
    """Distinct (value, member) of a column's values: member is true for all that filter_table was given, and for
    about a share ``fp`` of others. capacity and fp must be those of the filter."""
    bits, hashes = size_for(capacity, fp)
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    probes = values.select("value", F.explode(probe_positions(F.col("value"), hashes, bits)).alias("p"))
    probes = probes.select("value", F.bitmap_bucket_number("p").alias("bucket"), F.bitmap_bit_position("p").alias("at")).join(bitmaps, "bucket", "left")
    byte = F.conv(F.hex(F.substr("bitmap", (F.floor(F.col("at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    # a power of two by division: the place in the byte is a column
    bit = F.floor(byte / F.pow(F.lit(2.0), F.col("at") % 8)) % 2
    return probes.groupBy("value").agg((F.min(F.coalesce(bit, F.lit(0))) == 1).alias("member"))


class MemberFilter:
    """An approximate set of a column's values, built by a distributed aggregation (``add`` and ``contains``).

    Results of this library are exact and do not use it; it serves callers who want an approximate test on the
    driver. Its size is fixed by capacity and rate.
    """

    def __init__(self, df: DataFrame, column: str, capacity: int, fp: float = 0.001):
        self._filter = df._jdf.stat().bloomFilter(column, capacity, fp)

    def contains(self, value) -> bool:
        return bool(self._filter.mightContain(value))

    def add(self, value) -> bool:
        """Adds a value; whether it was new."""
        return bool(self._filter.put(value))

    def merge(self, other: MemberFilter) -> MemberFilter:
        self._filter.mergeInPlace(other._filter)
        return self

    @property
    def bits(self) -> int:
        return int(self._filter.bitSize())
