"""scholargraph: a researcher knowledge graph built from Spark DataFrame operators.

Every public operator is a function ``f(DataFrame..., params) -> DataFrame``.
"""
from scholargraph.session import get_session  # noqa: F401

__all__ = ["get_session"]
