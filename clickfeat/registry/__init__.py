"""All runnable operators and the SQL to check them against."""

from clickfeat.registry import columns, features, files, modelling  # noqa: F401
from clickfeat.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
