"""All registered queries; importing this module fills the registry."""
from scholargraph.plans import q_batch, q_dimensions, q_eval, q_graph, q_ingest, q_network, q_persons, q_search, q_votes  # noqa: F401
from scholargraph.plans.registry import ORACLE, QUERIES  # noqa: F401
