"""tokenweave: analytics over token-level text corpora, written for Spark."""

__version__ = "0.1.0"
