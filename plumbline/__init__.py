"""Gated, traceable statistical reporting over tables, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
