"""Imports every query module of this package, so that the registry is complete."""

from answerlab.llm import q_audit, q_corpus, q_native, q_tables  # noqa: F401
from answerlab.llm.registry import QUERIES

__all__ = ["QUERIES"]
