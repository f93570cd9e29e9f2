"""Checked queries: every operator beside an independent SQL statement of its result."""

from registry.base import ORACLES, QUERIES
from registry import corpora, cleaning, sampling, vocabulary, examples, noise, scoring, splits  # noqa: F401,E402

__all__ = ["ORACLES", "QUERIES"]
