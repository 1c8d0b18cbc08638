"""Limits and thresholds. Every operator takes the group it needs as an argument."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class IndexLimits:
    """What one index takes. None is no limit; nothing is left out unless the caller names one."""

    max_file_bytes: int | None = None
    max_total_bytes: int | None = None
    max_files: int | None = None
    max_chunk_chars: int = 8_000
    max_chunk_lines: int = 120


@dataclass(frozen=True)
class SearchSettings:
    semantic_candidates: int = 40
    lexical_candidates: int = 40
    default_top_k: int = 8
    max_top_k: int = 50
    rrf_k: int = 60
    strong_coverage: float = 0.5
    agreement_depth: int = 10
    useful_excess: float = 0.5
    weak_excess: float = 0.25
    min_pool: int = 8
    near_jaccard: float = 0.9
    near_min_tokens: int = 12


@dataclass(frozen=True)
class ContextSettings:
    max_chars: int = 24_000
    max_sources: int = 12
    source_overhead: int = 200
    min_useful_chars: int = 200
    per_file: int = 3
    no_evidence_sources: int = 3


@dataclass(frozen=True)
class EditLimits:
    max_edits: int = 20
    max_path_chars: int = 1_000
    max_patched_bytes: int = 2_000_000
    diff_context: int = 3


INDEX = IndexLimits()
SEARCH = SearchSettings()
CONTEXT = ContextSettings()
EDITS = EditLimits()
