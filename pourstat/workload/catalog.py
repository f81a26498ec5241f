"""Imports every module that registers queries."""

from pourstat.workload import clean_queries, extract_queries, learning_queries, mix_queries, model_queries, profile_queries  # noqa: F401
from pourstat.workload.registry import REGISTRY  # noqa: F401
