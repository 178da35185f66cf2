"""Parameters of a comparison."""

from __future__ import annotations

from dataclasses import asdict, dataclass

MODES = ("lemma", "root", "combined")


@dataclass(frozen=True)
class Params:
    """Defaults are those the results are known for. ``match_score`` is accepted and kept but has no effect on scoring;
    ``no_filters`` turns off the four metric bounds but not ``min_weighted_similarity``."""

    window_size: int = 275
    stride: int = 60
    ngram_size: int = 5
    min_shared_shingles: int = 3
    min_length: int = 10
    min_similarity: float = 0.0
    match_score: int = 2
    mismatch_penalty: int = -1
    gap_penalty: int = -1
    brute_force: bool = False
    mode: str = "combined"
    lemma_score: int = 2
    root_score: int = 1
    use_weights: bool = True
    min_weighted_similarity: float | None = None
    no_filters: bool = False
    min_core_similarity: float = 0.85
    min_span_coverage: float = 0.30
    min_content_weight: float = 1.10
    min_lexical_diversity: float = 0.55

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        for name in ("window_size", "stride", "ngram_size"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.min_length < 0 or self.min_shared_shingles < 0:
            raise ValueError("bounds must not be negative")
        if self.gap_penalty > 0 or self.mismatch_penalty > 0:
            raise ValueError("penalties must not be positive")

    def bounds(self) -> dict[str, float]:
        """The metric bounds in effect, by column."""
        out = {} if self.min_weighted_similarity is None else {"weighted_similarity": self.min_weighted_similarity}
        if not self.no_filters:
            out |= {"core_similarity": self.min_core_similarity, "span_coverage": self.min_span_coverage, "content_weight": self.min_content_weight, "lexical_diversity": self.min_lexical_diversity}
        return out

    def as_dict(self) -> dict:
        return asdict(self)
