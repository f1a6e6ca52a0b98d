"""Imports every module of queries, so that the registry is filled."""

from chronolake.plans import core_queries, more_queries, problems, state_queries  # noqa: F401
from chronolake.plans.registry import core  # noqa: F401
