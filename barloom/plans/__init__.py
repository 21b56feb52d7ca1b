"""Registered queries by family."""

from barloom.plans import decisions, evaluation, market, modeling, preparation, profile, storage, streams, trend  # noqa: F401
from barloom.plans.base import REGISTRY  # noqa: F401
