"""allelora: a PySpark-native engine for genetic-variant call data."""

__version__ = "0.1.0"
