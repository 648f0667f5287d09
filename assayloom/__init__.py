"""Composition analytics for safety documents, as Spark DataFrame operators."""
