"""Job parameters with the defaults a site profile starts from."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RetrievalSettings:
    top_k: int = 6
    min_score: float = 0.35
    max_context_characters: int = 8000
    max_citations: int = 3
    max_per_source: int = 2


@dataclass(frozen=True)
class ChunkSettings:
    max_chunk_characters: int = 2400
    min_chunk_characters: int = 300
    overlap_characters: int = 200
    split_on_heading_level: int = 3
    include_heading_path: bool = True


@dataclass(frozen=True)
class ConversationSettings:
    max_history: int = 12
    max_stored: int = 12
    max_prompt: int = 12
    idle_minutes: int = 60


@dataclass(frozen=True)
class CrawlSettings:
    max_depth: int = 3
    max_pages: int = 500
    requests_per_second: float = 1.0
    max_document_characters: int = 200_000


# Limits that results depend on.
MIN_DOCUMENT_TEXT = 120
MAX_PAGE_BYTES = 5_000_000
MAX_SITEMAP_DEPTH = 2
PRUNE_MIN_COVERAGE = 0.5
EMBED_BATCH = 16
MAX_TOOL_ROUNDS = 3
PROPOSAL_LIFETIME_SECONDS = 600
MAX_CART_LINES = 4
MAX_CART_QUANTITY = 10
MAX_COMPARE = 4
MAX_ORDERS = 5
MAX_LISTING = 10
CONTENT_TYPES = ("page", "faq", "guide", "policy", "blog", "other")
LATENCY_BOUNDS_MS = (25, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 30000, 60000)
TOKEN_BOUNDS = (100, 250, 500, 1000, 2000, 4000, 8000, 16000, 32000)
