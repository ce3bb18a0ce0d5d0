"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from . import bpe, chat, decontaminate, lines, quality, simhash, suffixes, toxicity, unigram, urls

MODULES = (suffixes, decontaminate, chat, toxicity, quality, lines, unigram, bpe, simhash, urls)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
