"""quire: document and media-timeline analytics, declared on Spark DataFrames."""

__version__ = "0.1.0"
