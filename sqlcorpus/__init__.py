"""Text-to-SQL corpus preparation on Spark: check, index, rewrite, split, describe, score."""

__version__ = "0.1.0"
