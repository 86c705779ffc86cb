"""Registered queries of the training-data operators."""

from prepspark.llm import bpe, decontaminate, html, interactions, language, packing, pii, quality, secrets, simhash, substrings, trie, urls  # noqa: F401
from prepspark.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
