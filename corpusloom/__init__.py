"""Batch and streaming Spark jobs for retrieval-augmented knowledge bases."""
