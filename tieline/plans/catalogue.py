"""Imports every query module, which registers its queries."""

from tieline.plans import corpus_queries, eval_queries, graph_queries, retrieval_queries, rollup_queries, source_queries, vector_queries  # noqa: F401
from tieline.plans.registry import COVERS, ORACLES, QUERIES  # noqa: F401
