"""Constants and thresholds of the curation library, in one frozen place."""

from __future__ import annotations

from dataclasses import dataclass, field

# The rubric's dimensions and weights in hundredths, and the thresholds, also in hundredths.
RUBRIC_WEIGHTS = {
    "factuality": 30,
    "instruction_clarity": 20,
    "response_quality": 25,
    "domain_relevance": 15,
    "format_compliance": 10,
}
RUBRIC_MIN, RUBRIC_MAX = 1, 5


@dataclass(frozen=True)
class Settings:
    accept: int = 350
    revise_low: int = 300
    revise_high: int = 340
    gap_policy: str = "reject"  # of composites between revise_high and accept
    similarity_reject: float = 0.92
    jaccard: float = 0.7
    permutations: int = 128
    bands: int = 14
    band_rows: int = 9
    ngram: int = 5
    embedding_dim: int = 384
    generator_batch: int = 10
    screening_batch: int = 3
    checkpoint_every: int = 100
    min_coverage: int = 3
    roles: dict = field(default_factory=lambda: {"generator": (0.9, 4096), "prefilter": (0.2, 1024), "scorer": (0.0, 2048)})


DEFAULTS = Settings()
# The built-in taxonomy for a free-text brief; any dimensions would do.
GENERIC_TAXONOMY = {
    "reader": ["child", "student", "specialist", "manager", "newcomer"],
    "answer_length": ["one sentence", "a paragraph", "several paragraphs"],
    "answer_form": ["prose", "numbered steps", "table", "dialogue"],
    "knowledge_needed": ["everyday", "trained", "expert"],
}
