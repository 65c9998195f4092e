"""Log, cost and semantic-search analytics expressed as PySpark jobs."""

__version__ = "0.1.0"
