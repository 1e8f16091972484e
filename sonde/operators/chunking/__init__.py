"""Documents to chunks at three granularities, and links."""

from .dispatch import chunk_documents, chunk_edges, plain_chunks

__all__ = ["chunk_documents", "chunk_edges", "plain_chunks"]
