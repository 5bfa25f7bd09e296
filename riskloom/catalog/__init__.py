"""All registered queries."""

from . import derivation, drifting, encoding, modelling, profiling, scoring  # noqa: F401
from .registry import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
