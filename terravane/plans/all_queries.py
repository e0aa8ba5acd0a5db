"""Imports every module of queries, which registers them."""

from terravane.plans import geometry, scene, semantics, spatial, tables  # noqa: F401
from terravane.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
