"""Timestamp-first analytics on Spark: stores, alignment, vectors, ranking and sequences as DataFrame operators."""

__version__ = "0.1.0"
