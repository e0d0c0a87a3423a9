"""Importing this module registers every query."""
from . import (q_features, q_knn, q_models, q_plans, q_sampling, q_scores,  # noqa: F401
               q_sources, q_text)
from .registry import QUERIES, SQL  # noqa: F401
