"""Values that change results, in one frozen object, and the enumerations of the data model."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Fixed values that results depend on.
    chunk_size: int = 800
    chunk_overlap: int = 120
    bulk_size: int = 2000
    bulk_overlap: int = 240
    top_k: int = 5
    corrective_fetch_k: int = 15
    max_corrective_rounds: int = 1
    correct_threshold: float = 0.50
    wrong_threshold: float = 0.05
    max_citation_retries: int = 2
    entailment_threshold: float = 0.20
    policy: str = "concat"
    max_premise_chars: int = 4000
    abstain_above: float = 0.50
    min_surviving_sentences: int = 1
    min_surviving_chars: int = 20
    price_in: float = 5.00
    price_out: float = 25.00
    price_cache_write: float = 6.25
    price_cache_read: float = 0.50
    seed: int = 42
    dev_size: int = 500
    test_size: int = 1000
    faithfulness_max_claims: int = 12


SETTINGS = Settings()

CHUNK_LABELS = ("correct", "ambiguous", "wrong")
ACTIONS = ("proceed", "corrective_retrieve", "abstain")
NLI_LABELS = ("entailment", "neutral", "contradiction")
REFUSAL = "cannot answer this from the provided sources"
#: The keys are fixed values.
ABSTAIN_REASONS = {
    "no_usable_chunk": "Retrieval found nothing that the grader would use.",
    "too_much_unsupported": "More of the draft lacks support than the limit allows.",
    "fragment_after_drops": "What is left after dropping sentences is too short to stand alone.",
    "nothing_survived": "Every sentence was dropped.",
    "generator_abstained": "The generator declined to answer from these passages.",
    "generation_failed": "No draft came back from the generator.",
}
