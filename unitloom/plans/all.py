"""Importing this module registers every query."""

from . import chats, corpus, evaluation, mixtures, rewriting, runlogs, statistics, streams, vectoring, windowing  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
