"""Settings of the engine as one immutable object; nothing here has side effects."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    child_tokens: int = 256
    child_overlap: int = 30
    parent_tokens: int = 1024
    parent_overlap: int = 100
    enable_ocr: bool = True
    enable_vision: bool = True
    enable_parent_child: bool = True
    enable_quality: bool = True
    enable_dedup: bool = True
    enable_cleaning: bool = True
    enable_captions: bool = True
    enable_structure: bool = True
    enable_vector: bool = True
    min_quality: float = 0.30
    dedup_threshold: float = 0.85
    minhash_slots: int = 128
    shingle: int = 3
    column_snap: int = 10
    column_overlap: float = 0.60
    min_cells: int = 2
    min_page_chars: int = 20
    blank_page_chars: int = 50
    header_lines: int = 3
    header_share: float = 0.3
    top_k: int = 10
    pool: int = 50
    alpha: float = 0.7
    use_parent: bool = True
    k1: float = 1.5
    b: float = 0.75
    embedding_provider: str = "hashed"
    llm_provider: str = "offline"
    dim: int = 64
    max_answer_tokens: int = 1024
    temperature: float = 0.0
    #: False reproduces the page filter that skips scanned pages before they are recognised.
    keep_pages_with_images: bool = True

    def __post_init__(self) -> None:
        for limit, overlap in ((self.child_tokens, self.child_overlap), (self.parent_tokens, self.parent_overlap)):
            if not 0 <= overlap < limit:
                raise ValueError("an overlap must be at least 0 and below its limit")
