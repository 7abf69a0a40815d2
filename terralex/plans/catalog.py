"""Importing this module fills the query registry."""

from terralex.plans import q_adjust, q_features, q_learn, q_profiles, q_quality, q_spatial, q_tables, q_temporal, q_text  # noqa: F401
from terralex.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
