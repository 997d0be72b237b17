"""Spark-first spectra clustering and data-processing operators."""

__version__ = "0.1.0"
