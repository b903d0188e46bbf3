"""Queries of the subpackage and their SQL counterparts."""

from __future__ import annotations

from turfline.llm import leakage_queries, linkage_queries, mixing_queries, name_queries, qdigest_queries, similarity_queries, survivorship_queries, truncation_queries

QUERIES: dict = {}
ORACLES: dict = {}
for module in (
    linkage_queries, similarity_queries, name_queries, survivorship_queries, qdigest_queries, leakage_queries, mixing_queries, truncation_queries,
):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
