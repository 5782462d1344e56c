"""The three entry points as chains of DataFrames: build keys, count them, estimate abundance."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from sigwright.operators.count import key_counts
from sigwright.operators.estimate import abundance, estimate_genes, weight_classes
from sigwright.operators.index import signature_regions
from sigwright.operators.select import key_positions, selected_keys
from sigwright.operators.similarity import cluster_transcripts
from sigwright.options import ClusterOptions, EstimateOptions, SelectOptions
from sigwright.runtime import cut


@dataclass(frozen=True)
class Keys:
    """transcripts (gid, tidx, tid, seq) by cluster; keys (gid, key); positions (gid, key, tidx, position)."""

    transcripts: DataFrame
    keys: DataFrame
    positions: DataFrame


def build_keys(transcripts: DataFrame, options: SelectOptions, genes: DataFrame | None = None, cluster: ClusterOptions | None = None) -> Keys:
    """Keys of clusters of similar genes, or of genes as they are if no cluster options are given. Regions and
    keys are written once, as several later steps read them."""
    if cluster is not None:
        transcripts = cut(cluster_transcripts(transcripts, genes, cluster), "clusters")
    regions = cut(signature_regions(transcripts, options.k), "regions")
    keys = cut(selected_keys(regions, options.k, options.keys_per_region), "keys")
    return Keys(transcripts, keys, cut(key_positions(regions, keys, options.k, options.least_keys), "positions"))


def quantify(built: Keys, reads: DataFrame, options: EstimateOptions, rounds: int | None = None) -> DataFrame:
    """(tid, length, est_reads, rpkm, tpm) of every transcript."""
    counts = key_counts(built.keys, reads, options.k)
    classes = cut(weight_classes(counts, built.positions, built.transcripts), "classes")
    return abundance(built.transcripts, estimate_genes(classes, options, rounds), options)
