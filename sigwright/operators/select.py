"""Keys: a strided sample of a gene's signature k-mers, and where they stand in its transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwright.functions import dna
from sigwright.operators.kmers import exploded


def sampled(regions: DataFrame, k: int, keys_per_region: int) -> DataFrame:
    """(gid, tidx, key) before keys of a gene become distinct: canonical k-mers at strided offsets."""
    step = dna.stride(F.col("length"), keys_per_region)
    offsets = F.explode(dna.region_offsets(F.char_length("seq") - k, step))
    picked = regions.select("gid", "tidx", "seq", offsets.alias("o"))
    return picked.select("gid", "tidx", dna.canonical(F.substr("seq", F.col("o") + 1, F.lit(k))).alias("key"))


def selected_keys(regions: DataFrame, k: int, keys_per_region: int) -> DataFrame:
    """Distinct (gid, key)."""
    return sampled(regions, k, keys_per_region).select("gid", "key").distinct()


def key_occurrences(regions: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """(gid, key, tidx, position) for each orientation of a key at each window of its gene's regions.

    A palindrome has equal orientations and so stands at a place twice.
    """
    oriented = keys.select("gid", "key", F.explode(dna.orientations(F.col("key"))).alias("kmer"))
    places = exploded(regions, k, "gid", "tidx", "position")
    places = places.select("gid", "tidx", (F.col("position") + F.col("pos")).alias("position"), "kmer")
    return oriented.join(places, ["gid", "kmer"]).select("gid", "key", "tidx", "position")


def keys_per_transcript(occurrences: DataFrame) -> DataFrame:
    """(gid, tidx, n_keys) distinct keys that stand in a transcript."""
    return occurrences.select("gid", "tidx", "key").distinct().groupBy("gid", "tidx").agg(F.count("*").alias("n_keys"))


def skipped_transcripts(occurrences: DataFrame, least_keys: int = 3) -> DataFrame:
    """(gid, tidx, n_keys) of transcripts with too few keys; their places are dropped, their keys stay."""
    return keys_per_transcript(occurrences).filter(F.col("n_keys") < least_keys)


def key_positions(regions: DataFrame, keys: DataFrame, k: int, least_keys: int = 3) -> DataFrame:
    """key_occurrences without the places of skipped transcripts."""
    found = key_occurrences(regions, keys, k)
    return found.join(skipped_transcripts(found, least_keys), ["gid", "tidx"], "left_anti").select("gid", "key", "tidx", "position")


def nested_keys(keys: DataFrame, positions: DataFrame) -> DataFrame:
    """(gid, key, transcript_infos array<struct<tidx, positions>>) with every key of keys, infos by tidx."""
    by_tx = positions.groupBy("gid", "key", "tidx").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    infos = by_tx.groupBy("gid", "key").agg(F.array_sort(F.collect_list(F.struct("tidx", "positions"))).alias("transcript_infos"))
    return keys.join(infos, ["gid", "key"], "left").select("gid", "key", F.coalesce("transcript_infos", F.array().cast(infos.schema["transcript_infos"].dataType)).alias("transcript_infos"))


def totals(regions: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """One row: selected keys, and signature k-mers looked through (one more than windows for each region)."""
    scanned = regions.agg(F.coalesce(F.sum(F.char_length("seq") - k + 1), F.lit(0)).cast("long").alias("scanned"))
    return keys.agg(F.count("*").alias("selected")).crossJoin(scanned)


def out_of_bounds(positions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(gid, tidx, n) of transcripts with places that lie behind their end: an assertion on the input."""
    places = positions.join(transcripts.select("gid", "tidx", F.char_length("seq").alias("length")), ["gid", "tidx"])
    return places.filter(F.col("position") >= F.col("length")).groupBy("gid", "tidx").agg(F.count("*").alias("n"))


def key_records(counts: DataFrame, positions: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(gid, keys, tids, lengths): a gene's record, as the format SelectedKey of sources.framed has it.

    keys is array<struct<key, transcript_infos, count>> in order of keys, tids and lengths are in order of
    transcripts. counts: (gid, key, count). Genes without keys have no record.
    """
    nested = nested_keys(counts.select("gid", "key"), positions).join(counts, ["gid", "key"])
    each = F.struct("key", "transcript_infos", F.col("count").cast("int").alias("count"))
    keys = nested.groupBy("gid").agg(F.array_sort(F.collect_list(each), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)).alias("keys"))
    own = transcripts.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("tidx", "tid", F.char_length("seq").alias("length")))).alias("t"))
    of = lambda c: F.transform("t", lambda x: x[c]).alias(f"{c}s")
    return keys.join(own, "gid").select("gid", "keys", of("tid"), of("length"))
