"""Exact links between members of buckets, for groups of any size.

Buckets say which sets may be similar; only an exact comparison makes a link. Rows for all pairs of a bucket
would grow with the square of its size, so pairs are never rows. Where signatures are given, near components
come first: ids that share a bucket and are near enough by them; a star, everyone against the leader, settles
most of each. What is left meets by its rarest shingles: two sets at the least similarity share one of so many
of their rarest, which common shingles (templates, licences) are not among. Sets that meet so, in a class of
sizes, are compared with the first of them, and what that leaves open in tiles of two blocks of bounded size,
from which only links that join something leave.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sigwright.operators.components import connected_components
from sigwright.runtime import Cut, release_shuffles

#: Members of one block of a tile: of signatures, and of whole sets.
SIG_BLOCK = 1024
SET_BLOCK = 256


def active_buckets(keys: DataFrame) -> DataFrame:
    """(key, id) rows of buckets with two ids or more; of buckets with the same members one stays."""
    keys = keys.select("key", "id").distinct()
    return keys.join(_different(keys), "key")


def _different(keys: DataFrame) -> DataFrame:
    """(key) of distinct (key, id) rows with two ids or more; of keys with the same ids the least."""
    mark = F.xxhash64("id", F.lit(7)).cast("decimal(38,0)")
    by_key = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("z"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.sum(mark).alias("t"))
    return by_key.filter("n > 1").groupBy("n", "a", "z", "s", "t").agg(F.min("key").alias("key")).select("key")


def linked_components(buckets: DataFrame | None, sets: DataFrame, num: int, den: int, far: int | None = None) -> DataFrame:
    """(id, root) of ids with a link, den * intersection >= num * union. sets: (id, set array<long>), of all ids that
    may have one. Where far is given, sets have sig, a binary of 16-bit symbols, and only ids that share a bucket
    ((key, id) of active buckets) and differ in no more symbols are compared at first; links join their components
    alone. Rows of sets with one id are one member with several sets.
    """
    if far is None:
        links = None
        members = sets.select("id", "set", F.col("id").alias("label"))
    else:
        near = _near_components(buckets, sets.select("id", "sig"), far)
        sets = sets.select("id", "set")
        led = near.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        links = Cut(_verified(led, sets, num, den), "star-links").df
        linked = links.select(F.col("a").alias("node"), F.lit(True).alias("linked")).distinct()
        marked = near.join(linked, "node", "left").withColumn("label", F.when(F.col("linked"), F.col("root")).otherwise(F.col("node")))
        # with its leader everyone has been compared: only two others can still be linked
        rest = marked.groupBy("root").agg(F.count("*").alias("n"), F.count_if(F.col("label") != F.col("root")).alias("left")).filter("n > 2 AND left > 0")
        members = marked.join(rest.select("root"), "root").select(F.col("node").alias("id"), "label").join(sets, "id").select("id", "set", "label")
    keyed_cut = Cut(_meeting(members, num, den), "meeting")
    keyed = keyed_cut.df
    release_shuffles(sets.sparkSession)
    lead = keyed.groupBy("key").agg(F.min(F.struct("label", "id", "size")).alias("l"))
    led = keyed.join(lead, "key").filter((F.col("label") != F.col("l.label")) & _sizes_fit(F.col("size"), F.col("l.size"), num, den))
    stars = Cut(_verified(led.select(F.col("id").alias("a"), F.col("l.id").alias("b")).distinct(), sets, num, den), "meeting-stars").df
    links = stars if links is None else links.unionByName(stars)
    roots = connected_components(links, "a", "b").select(F.col("node").alias("id"), "root")
    # with their leader all members of a bucket have been compared, and what it joined has one label by now
    labels = keyed.drop("label").join(roots, "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root")
    open_ = labels.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("n > 2 AND lo <> hi").select("key", "n")
    left = Cut(labels.join(open_, "key"), "meeting-open").df
    if left.limit(1).count():
        # sets that share one rare shingle share many: they are compared under one of these
        left = Cut(left.join(_different(left.select("key", "id").distinct()), "key"), "meeting-different").df
        found = Cut(_compared(left, sets, num, den), "tile-links").df
        if found.limit(1).count():
            roots = _joined(roots, found)
    keyed_cut.drop()
    return roots


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root) of components, given as such, that further links (a, b) join; the stars of roots stand for the links behind them."""
    return connected_components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(links), "a", "b").select(F.col("node").alias("id"), "root")


def _sizes_fit(x: Column, y: Column, num: int, den: int) -> Column:
    return den * F.least(x, y) >= num * F.greatest(x, y)


def _meeting(members: DataFrame, num: int, den: int) -> DataFrame:
    """(key, id, label, size) of members (id, set, label) by their rarest shingles and class of size; only keys
    with two labels. Members with a link between them share a key."""
    rows = members.select("id", "label", F.xxhash64("id", "set").alias("row"), F.size("set").alias("size"), "set")
    tokens = rows.select("id", "label", "row", "size", F.explode("set").alias("shingle"))
    common = tokens.groupBy("shingle").agg(F.count("*").alias("held"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("held > 1").select("shingle", "held", (F.col("lo") != F.col("hi")).alias("apart"))
    shared = tokens.join(common, "shingle")
    # shingles that nobody else holds are the rarest of all: they take their places and join nothing
    own = Window.partitionBy("row")
    places = F.col("size") - F.ceil(F.lit(num) * F.col("size") / den) + 1 - (F.col("size") - F.count("*").over(own))
    ranked = shared.withColumns({"places": places, "rank": F.row_number().over(own.orderBy("held", "shingle"))}).filter("rank <= places AND apart")
    size_class = F.floor(F.log(F.col("size").cast("double")) / math.log(den / num) + 1e-9).cast("int")
    classes = ranked.select("id", "label", "size", "shingle", F.explode(F.array(size_class, size_class + 1)).alias("class"))
    keyed = classes.select(F.xxhash64("shingle", "class").alias("key"), "id", "label", "size")
    several = keyed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    return keyed.join(several, "key")


def _compared(left: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that join labels within keys; left: (key, id, label, size, n)."""

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        column = group.column("set").combine_chunks()
        flat, ends = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        ids = group.column("id").to_numpy()
        links = set_links(flat, ends, group.column("label").to_numpy(), group.column("block").to_numpy(), num, den)
        return pa.table({"a": pa.array([ids[i] for i, _ in links], pa.int64()), "b": pa.array([ids[j] for _, j in links], pa.int64())})

    tiles = _tiled(left.select("key", "id", "label", "n").join(sets, "id"), "key", SET_BLOCK).select("key", "one", "two", "block", "id", "label", "set")
    return tiles.groupBy("key", "one", "two").applyInArrow(compare, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) rows of pairs that are linked."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    a, b = F.size("set_a"), F.size("set_b")
    # sets of too different sizes can't be linked: no intersection needed
    linked = _sizes_fit(a, b, num, den) & (den * both >= num * (a + b - both))
    return pairs.join(left, "a").join(right, "b").filter(linked).select("a", "b")


def _near_components(buckets: DataFrame, sigs: DataFrame, far: int) -> DataFrame:
    """(node, root) of components of ids that share a bucket and differ in ``far`` symbols at most."""
    lead = buckets.groupBy("key").agg(F.min("id").alias("l"), F.count("*").alias("n"))
    pairs = buckets.join(lead, "key").filter("id <> l").select("id", "l").distinct()
    one, two = sigs.select("id", F.col("sig").alias("x")), sigs.select(F.col("id").alias("l"), F.col("sig").alias("y"))
    stars = Cut(pairs.join(one, "id").join(two, "l").filter(differing(F.col("x"), F.col("y")) <= far).select("id", "l"), "sig-links").df
    roots = connected_components(stars, "id", "l").withColumnRenamed("node", "id")
    marked = buckets.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("label"))
    rest = marked.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("n > 2 AND lo <> hi")
    members = marked.join(rest.select("key", "n"), "key").join(sigs, "id")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids = group.column("id").to_numpy()
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
        links = sig_links(sig, group.column("label").to_numpy(), group.column("block").to_numpy(), far)
        return pa.table({"a": pa.array([ids[i] for i, _ in links], pa.int64()), "b": pa.array([ids[j] for _, j in links], pa.int64())})

    tiles = _tiled(members, "key", SIG_BLOCK).select("key", "one", "two", "block", "id", "label", "sig")
    found = Cut(tiles.groupBy("key", "one", "two").applyInArrow(compare, "a long, b long").distinct(), "sig-tiles").df
    if found.limit(1).count():
        roots = _joined(roots, found)
    return roots.withColumnRenamed("id", "node")


def differing(x: Column, y: Column) -> Column:
    """Number of 16-bit symbols in which two signatures differ."""
    digits = F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / 2).cast("int")), lambda i: F.substring(x, 2 * i + 1, 2) != F.substring(y, 2 * i + 1, 2))
    return F.size(F.filter(digits, lambda d: d))


def _tiled(members: DataFrame, group: str, block: int) -> DataFrame:
    """members, with n the size of their group, once for each tile (one <= two) of their block."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", group), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})


def _joiner(labels: np.ndarray):
    """(roots, join): roots by member, and a function that joins member i with others and gives the links that
    joined something."""
    _, roots = np.unique(labels, return_inverse=True)

    def join(i: int, others: np.ndarray) -> list[tuple[int, int]]:
        out = []
        fresh = others[roots[others] != roots[i]]
        while len(fresh):
            j = int(fresh[0])
            out.append((i, j))
            roots[roots == roots[j]] = roots[i]
            fresh = fresh[roots[fresh] != roots[i]]
        return out

    return roots, join


def _partners(blocks: np.ndarray) -> tuple[np.ndarray, bool]:
    """The members to go through, and whether the tile has two blocks."""
    low = blocks.min()
    return np.flatnonzero(blocks == low), bool((blocks != low).any())


def sig_links(sigs: np.ndarray, labels: np.ndarray, blocks: np.ndarray, far: int) -> list[tuple[int, int]]:
    """Pairs of members within ``far`` symbols that join labels; in a tile of two blocks, between these."""
    roots, join = _joiner(labels)
    out: list[tuple[int, int]] = []
    mine, two = _partners(blocks)
    for i in mine.tolist():
        others = np.flatnonzero((roots != roots[i]) & ((blocks != blocks[i]) if two else True))
        if len(others):
            out += join(i, others[(sigs[others] != sigs[i]).sum(1) <= far])
    return out


def set_links(flat: np.ndarray, ends: np.ndarray, labels: np.ndarray, blocks: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of members with linked sets that join labels; member i has the values flat[ends[i]:ends[i + 1]]."""
    roots, join = _joiner(labels)
    sizes = np.diff(ends)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, value = np.unique(flat, return_inverse=True)
    order = np.argsort(value, kind="stable")
    holders = owner[order]
    starts = np.concatenate([[0], np.cumsum(np.bincount(value))])
    out: list[tuple[int, int]] = []
    mine, two = _partners(blocks)
    for i in mine.tolist():
        other = (roots != roots[i]) & (den * np.minimum(sizes, sizes[i]) >= num * np.maximum(sizes, sizes[i]))
        if two:
            other &= blocks != blocks[i]
        if not other.any():
            continue
        v = value[ends[i] : ends[i + 1]]
        counts = starts[v + 1] - starts[v]
        at = np.repeat(starts[v] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        both = np.bincount(holders[at], minlength=len(sizes))
        out += join(i, np.flatnonzero(other & (den * both >= num * (sizes + sizes[i] - both))))
    return out
