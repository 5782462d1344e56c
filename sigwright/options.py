"""Options of the stages, with the defaults of the method."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ClusterOptions:
    k: int = 40
    threshold: float = 0.1
    samples: int = 20


@dataclass(frozen=True)
class SelectOptions:
    k: int = 40
    keys_per_region: int = 10
    least_keys: int = 3


@dataclass(frozen=True)
class EstimateOptions:
    k: int = 40
    read_length: int = 100
    tolerance: float = 1e-10
    max_rounds: int = 500_000
    least_count: float = 1e-7
    least_abundance: float = 0.1
    #: Entries of a gene's weight classes up to which one task estimates it.
    group_entries: int = 4_000_000
