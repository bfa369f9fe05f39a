"""Curated-knowledge analytics on Spark: retrieval, dedup, consolidation, sync, log mining and rendering as DataFrame operators."""
