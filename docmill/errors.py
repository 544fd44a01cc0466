"""Error names.  In batch work a failing document becomes a row with its
message; these are raised for wrong configuration and by single calls."""


class ChunkingError(Exception):
    """A document couldn't be chunked."""


class VectorStoreError(Exception):
    """Base of the vector store's errors."""


class DatabaseConnectionError(VectorStoreError):
    """The vector table can't be reached."""


class EmbeddingError(VectorStoreError):
    """Chunks couldn't be embedded."""


class CommitConflict(VectorStoreError):
    """Another session changed what this one replaces."""


class FetchError(OSError):
    """A page couldn't be fetched; ``lasting`` if asking again is of no use."""

    def __init__(self, message: str, status: int | None = None, lasting: bool = False):
        super().__init__(message)
        self.status, self.lasting = status, lasting
