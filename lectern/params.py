"""All tunable constants in one immutable dataclass.

Fixed values that define the reference behaviour (chunk budget, retrieval
cut-offs, cache TTL, history lengths) are defaults here; every operator takes a
``Params`` so a caller can change them per job.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # Chunking (tokens): target size, overlap carried into the next chunk and
    # the ceiling above which one element is force-split into windows.
    chunk_size: int = 200
    chunk_overlap: int = 30
    max_chunk_tokens: int = 300
    # Elements per block of the parallel chunk fold (bounds one task's group),
    # and blocks per super-block of its two-level composition.
    chunk_block: int = 65536
    chunk_superblock: int = 4096

    # Retrieval.
    top_k: int = 8
    threshold: float = 0.60
    isolation_floor: float = 0.55
    gap: float = 0.10
    cap: int = 3
    score_digits: int = 4
    # Exact kNN: most vectors and bytes of one block of vectors.
    knn_query_block: int = 4096
    knn_max_block_bytes: int = 16 * 1024 * 1024

    # Embedding.
    embed_batch: int = 32
    embed_dim: int = 64

    # Response cache.
    cache_ttl_seconds: int = 86_400

    # Conversation memory.
    history_prompt: int = 5
    history_rewrite: int = 3

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT = Params()
