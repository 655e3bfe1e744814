"""Default parameters, grouped as the engine uses them; each group checks its ranges."""

from __future__ import annotations

from dataclasses import dataclass, field


def _between(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be in [{low}, {high}], not {value}")


@dataclass(frozen=True)
class Fusion:
    rrf_k: int = 60
    vector_weight: float = 0.7
    sparse_weight: float = 0.3

    def __post_init__(self):
        _between("rrf_k", self.rrf_k, 1, 1_000_000)


@dataclass(frozen=True)
class Sparse:
    mode: str = "auto"
    tokenizer: str = "word"
    ngram: int = 2
    candidate_k: int = 80
    relation_k: int = 60
    max_doc_len: int = 2000
    relation_max_doc_len: int = 512
    auto_floor: float = 0.45
    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self):
        if self.tokenizer not in ("word", "char_ngram", "mixed"):
            raise ValueError(f"tokenizer must be word, char_ngram or mixed, not {self.tokenizer}")


@dataclass(frozen=True)
class Threshold:
    low: float = 0.3
    high: float = 0.95
    percentile: float = 75.0
    sigma: float = 1.5
    min_results: int = 3
    gap_mode: str = "smallest"

    def __post_init__(self):
        _between("low", self.low, 0, 1)
        _between("high", self.high, self.low, 1)
        _between("percentile", self.percentile, 0, 100)


@dataclass(frozen=True)
class RelationIntent:
    alpha: float = 0.35
    candidate_multiplier: int = 4
    preserve: int = 3
    pair_limit: int = 3


@dataclass(frozen=True)
class Graph:
    recall_k: int = 24
    two_hop_below: int = 3
    alpha: float = 0.85
    max_iter: int = 100
    tol: float = 1e-6
    max_depth: int = 3
    max_paths: int = 5
    min_weight: float = 0.1
    max_weight: float = 10.0


@dataclass(frozen=True)
class Memory:
    half_life_hours: float = 24.0
    tick_hours: float = 1.0
    prune_below: float = 0.1
    cooldown_s: float = 3600.0
    revive_to: float = 0.5
    protect_s: float = 86400.0
    freeze_s: float = 86400.0
    retention_s: float = 7 * 86400.0
    grace_s: float = 86400.0


@dataclass(frozen=True)
class Episode:
    max_paragraphs: int = 20
    max_chars: int = 6000
    window_s: float = 86400.0
    max_keywords: int = 12
    max_participants: int = 16


@dataclass(frozen=True)
class Config:
    top_k_relations: int = 10
    top_k_paragraphs: int = 20
    top_k_final: int = 10
    alpha: float = 0.5
    ppr_weight: float = 0.3
    temporal_multiplier: int = 8
    max_scan: int = 1000
    path_below: float = 0.6
    aggregate_k: int = 60
    fusion: Fusion = field(default_factory=Fusion)
    sparse: Sparse = field(default_factory=Sparse)
    threshold: Threshold = field(default_factory=Threshold)
    intent: RelationIntent = field(default_factory=RelationIntent)
    graph: Graph = field(default_factory=Graph)
    memory: Memory = field(default_factory=Memory)
    episode: Episode = field(default_factory=Episode)

    def __post_init__(self):
        _between("alpha", self.alpha, 0, 1)
