"""Spark-native engine for curating, splitting, exporting and scoring labelled record sets."""

from lodesift.session import local_session

__all__ = ["local_session"]
