"""Settings; all are arguments, nothing is read from the environment at import."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChunkConfig:
    """Chunker settings.  Sizes are compared as the operators document it."""

    max_size: int = 2000
    min_size: int = 700
    max_header_level: int = 6
    enable_semantic: bool = True
    tiny_chunk_threshold: int = 50
    model: str = "hashing-64"

    def __post_init__(self) -> None:
        if self.max_size <= self.min_size:
            raise ValueError("max_size must be greater than min_size")
        if not 1 <= self.max_header_level <= 6:
            raise ValueError("max_header_level is 1 to 6")


@dataclass(frozen=True)
class StoreConfig:
    """Vector store settings; ``path`` is the folder of the vector table.  With
    ``use_jsonb`` a vector's chunk metadata is stored with it, as JSON.  A batch
    that fails is tried ``attempts`` times, with growing pauses."""

    path: str
    collection_name: str = "documents"
    model_name: str = "hashing-64"
    batch_size: int = 100
    use_jsonb: bool = True
    attempts: int = 1

    def __post_init__(self) -> None:
        if not self.path:
            raise ValueError("the vector table's path must be given")
        if self.batch_size < 1:
            raise ValueError("batch_size is at least 1")
