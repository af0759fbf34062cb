"""Provenance-checked retrieval, evaluation and corpus preparation as PySpark DataFrame operators."""
