"""Settings, requests and errors."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

VERSIONS = {"extractor": "loom-extract-1", "chunker": "loom-chunk-1", "knowledge": "loom-knowledge-1", "entities": "loom-entities-1", "claims": "loom-claims-1", "provenance": "loom-provenance-1"}
INTENTS = ("summary", "comparative", "temporal", "exact", "entity", "semantic")
MODES = ("auto", "lexical", "dense", "hybrid", "entity")
STATES = ("pending", "indexing", "ready", "summarizing", "complete", "error")


@dataclass(frozen=True)
class Config:
    """Every knob of the engine and its default. chunk_overlap and retrain_fraction are accepted and unused."""

    chunk_max_chars: int = 1100
    chunk_min_chars: int = 200
    chunk_overlap: int = 0
    embedding_dim: int = 256
    embedding_provider: str = "lsa"
    lsa_dim: int = 128
    lsa_min_df: int = 2
    lsa_max_vocab: int = 8192
    semantic_min_chunks: int = 24
    retrain_fraction: float = 0.2
    rrf_k: int = 60
    weight_vector: float = 0.5
    weight_fts: float = 0.5
    mmr_lambda: float = 0.7
    enable_reranking: bool = True
    rerank_top_n: int = 24
    freshness_boost: float = 0.05
    max_dense_scan: int = 250_000
    ann_mode: str = "auto"
    ann_ef_search: int = 64
    ann_min_chunks: int = 20_000
    enable_knowledge_extraction: bool = True
    synchronous_ingestion: bool = True
    worker_threads: int = 1
    job_backoff_base_secs: int = 2
    job_backoff_max_secs: int = 300
    summary_temperature: float = 0.2
    summary_max_tokens: int = 256
    llm_timeout_secs: int = 300

    def replace(self, **changes) -> Config:
        return dataclasses.replace(self, **changes)


@dataclass(frozen=True)
class Filters:
    """Restrictions of a query; entities asks for any of the names, as_of bounds created_at."""

    document_ids: tuple[int, ...] = ()
    doc_types: tuple[str, ...] = ()
    must_contain: str | None = None
    entities: tuple[str, ...] = ()
    as_of: str | None = None

    def empty(self) -> bool:
        return self == Filters()


@dataclass(frozen=True)
class QueryRequest:
    text: str
    top_k: int = 8
    mode: str = "auto"
    filters: Filters = field(default_factory=Filters)
    include_provenance: bool = False
    include_graph: bool = False
    context_budget: int = 3000
    max_per_document: int = 3


class LoomError(Exception):
    """Any error of this package."""


class EmptyInput(LoomError): ...


class InputTooLarge(LoomError): ...


class Unsupported(LoomError): ...


class ExtractionFailed(LoomError): ...


class DocumentNotFound(LoomError): ...


class EntityNotFound(LoomError): ...


class EmptyQuery(LoomError): ...


class EmbeddingMismatch(LoomError): ...


class DenseScanTooLarge(LoomError): ...


class SchemaTooNew(LoomError): ...


class JobFailed(LoomError): ...


class ModelUnavailable(LoomError): ...
