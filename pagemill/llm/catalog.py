"""Queries and oracle SQL of the operators in this subpackage."""

from __future__ import annotations

from pagemill.llm import balance, bpe, exactdedup, forest, licenses, middle, mixing, negatives, perplexity, simhash, tokenfiles, toxicity, warc

MODULES = (warc, perplexity, bpe, exactdedup, mixing, balance, toxicity, licenses, simhash, tokenfiles, negatives, forest, middle)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in MODULES:
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
