"""docmill: document ingestion, chunking and retrieval preparation on Spark DataFrames."""

__version__ = "0.1.0"
