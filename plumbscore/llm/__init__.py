"""Operators for preparing training text, each with a query on the given tables."""

from plumbscore.llm import brown, chat, decontaminate, fingerprints, lexical, licenses, lockstep, packing, quality, simhash, toxicity, urls, warc  # noqa: F401
from plumbscore.llm.registered import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
