"""Registered queries: every operator applied to the driver's tables."""

from sensorloom.plans.registry import ORACLES, QUERIES
from sensorloom.plans import windowing, projections, evaluation, alignment, graphs, stores, learning, streams  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
