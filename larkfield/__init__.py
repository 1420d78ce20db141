"""Larkfield: fielded retrieval, graph mining and session analytics as Spark plans."""

__version__ = "0.1.0"
