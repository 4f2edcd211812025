"""Lodestone: evidence analytics and corpus preparation expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
