"""The queries and oracle SQL of this subpackage, gathered from its operator modules."""

from __future__ import annotations

from . import decontamination, embeddings, mixing, quality, secrets, sharding, simhash, substrings, toxicity, urls

MODULES = (decontamination, secrets, toxicity, simhash, embeddings, sharding, quality, substrings, urls, mixing)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
