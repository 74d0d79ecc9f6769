"""Settings of the engine, with the defaults a fresh installation has."""

from __future__ import annotations

from dataclasses import dataclass, field

# Starting weights of the AI-likelihood features, in the order they are summed.
DEFAULT_WEIGHTS = (
    ("lexicalDiversity", 0.15),
    ("burstiness", 0.25),
    ("personalPronouns", 0.15),
    ("aiCliches", 0.25),
    ("synonymChains", 0.1),
    ("perplexity", 0.1),
)


@dataclass(frozen=True)
class EngineConfig:
    shingle_size: int = 5
    chunk_shingles: int = 20
    chunk_step: int = 10
    signature_size: int = 64
    bands: int = 16
    candidate_gate: str = "lsh"  # or "none": every source that shares a shingle
    paraphrase_threshold: float = 0.75
    spam_top_words: int = 10
    verdict_threshold: float = 0.6
    weights: tuple[tuple[str, float], ...] = DEFAULT_WEIGHTS
    page_norm_chars: int = 1800
    words_per_minute: int = 200
    long_sentence_words: int = 25
    pronoun_share: float = 0.05
    perplexity_scale: float = 150.0
    language_least_chars: int = 20
    external_search: bool = False
    external_sample: int = 5
    max_file_mb: int = 25
    hard_file_mb: int = 200
    ocr: bool = True
    ocr_least_chars_a_page: int = 20
    max_retries: int = 3
    only_previous: bool = False  # self-copying: only documents with a smaller id count
    detector_off: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if self.candidate_gate not in ("lsh", "none"):
            raise ValueError(f"candidate_gate: {self.candidate_gate!r}")
        if self.signature_size % self.bands:
            raise ValueError("signature_size has to be a multiple of bands")
        if self.shingle_size < 1 or self.page_norm_chars < 1 or self.chunk_step < 1:
            raise ValueError("sizes have to be positive")
