"""Thresholds of the engine; every operator takes them as parameters with these defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CleanConfig:
    """Cleaning: lengths, near-duplicate settings, quality rules and the share that is kept."""

    min_chars: int = 500
    max_chars: int = 100_000
    permutations: int = 128
    jaccard: float = 0.8
    shingle: int = 5
    keep_quantile: float = 0.8
    word_len: tuple[float, float] = (3.0, 10.0)
    symbol_max: float = 0.1
    punct_min: float = 0.8
    stop_min: float = 0.3
    relaxed_symbol_max: float = 0.2
    relaxed_punct_min: float = 0.5
    relaxed_sources: tuple[str, ...] = ("arxiv",)
    #: crawl domain -> source name, so that rules by source apply to crawled pages
    source_alias: dict[str, str] = field(default_factory=lambda: {"export.arxiv.org": "arxiv", "arxiv.org": "arxiv", "www.gutenberg.org": "gutenberg"})


@dataclass(frozen=True)
class FactConfig:
    min_conf: float = 0.6
    # Classes that exclude each other, and pairs of objects that do.
    classes: tuple[str, ...] = ("bird", "mammal", "fish", "insect", "vehicle", "food", "plant", "tool")
    pairs: tuple[tuple[str, str], ...] = (("alive", "dead"), ("male", "female"), ("true", "false"))


@dataclass(frozen=True)
class GateConfig:
    min_gain: float = 0.01
    max_diversity_drop: float = 0.20
    human_gate_every: int = 3
    churn_bottleneck: float = 0.15
    churn_excuse: float = 0.02
    collapse_ratio: float = 0.5
    cycle_growth: float = 0.25
    damage_ratio: float = 1.05
    eps: float = 0.3
    h1_floor: float = 0.1


@dataclass(frozen=True)
class GraphConfig:
    relation: str = "is_a"
    min_conf: float = 0.6
    top_nodes: int = 800
    max_len: int = 5
    max_cycles: int = 10_000
    #: edges that the census may try; beyond, its count is a floor
    max_work: int = 2_000_000


CLEAN, FACTS, GATE, GRAPH = CleanConfig(), FactConfig(), GateConfig(), GraphConfig()
