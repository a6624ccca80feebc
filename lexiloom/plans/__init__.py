"""The registered queries of the library's own operators."""

from . import batching, clusters, corpus, embeddings, retrieval
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "batching", "clusters", "corpus", "embeddings", "retrieval"]
