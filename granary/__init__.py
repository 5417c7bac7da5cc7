"""Granary: Spark-first preparation and evaluation of text datasets."""

__version__ = "0.1.0"
