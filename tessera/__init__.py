"""A Spark-first code and text retrieval engine: sources, lexical and semantic search, graph, context planning."""

__version__ = "0.1.0"
