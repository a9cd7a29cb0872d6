"""All named queries; importing the query modules registers them."""

from repoloom.plans import analysis_queries, discovery_queries, estate_queries, output_queries, source_queries  # noqa: F401
from repoloom.plans.registry import ORACLES, RUNS  # noqa: F401
