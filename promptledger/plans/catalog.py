"""All queries of the engine by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import feed_queries, spend_queries, state_queries, text_queries

MODULES = (spend_queries, text_queries, state_queries, feed_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
