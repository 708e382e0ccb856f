"""Import every query module, so that the registry is full."""

from maskwright.plans import corpora, detection, evaluation, generation, more, usage  # noqa: F401
from maskwright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
