"""Broadsheet: news-page ingest, labelling and archive queries as Spark DataFrames."""

__version__ = "0.1.0"
